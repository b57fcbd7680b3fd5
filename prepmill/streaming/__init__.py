"""Applying fitted, row-wise work to files that keep arriving.

Scoring, casts, fills with fitted values, caps and conditional changes are narrow
projections, so they take a streaming DataFrame unchanged; this module only adds the
reading and writing around them.
"""

from .files import incoming_files, write_stream

__all__ = ["incoming_files", "write_stream"]
