from .updates import (
    DistanceMaintainer,
    file_update_stream,
    kafka_update_stream,
    maintain_distances,
    parse_kafka_rows,
    parse_update_lines,
    print_head,
)

__all__ = [
    "DistanceMaintainer",
    "file_update_stream",
    "kafka_update_stream",
    "maintain_distances",
    "parse_kafka_rows",
    "parse_update_lines",
    "print_head",
]
