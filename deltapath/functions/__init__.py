from .columns import (
    DISTANCE_TEXT_FORMAT,
    EDGE_TEXT_FORMAT,
    best_message,
    checked_weight,
    distance_text,
    edge_text,
    message,
    parse_edge_line,
)

__all__ = [
    "DISTANCE_TEXT_FORMAT",
    "EDGE_TEXT_FORMAT",
    "best_message",
    "checked_weight",
    "distance_text",
    "edge_text",
    "message",
    "parse_edge_line",
]
