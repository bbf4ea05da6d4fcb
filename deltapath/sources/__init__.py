from .fixtures import g_ev, g_ev_parts, g_ps, g_tree, transitions, update_stream
from .generators import nary_tree
from .tables import Tables, read_table
from .text import read_edge_text, read_update_text, write_edge_text, write_update_text

__all__ = [
    "Tables",
    "g_ev",
    "g_ev_parts",
    "g_ps",
    "g_tree",
    "nary_tree",
    "read_edge_text",
    "read_table",
    "read_update_text",
    "transitions",
    "update_stream",
    "write_edge_text",
    "write_update_text",
]
