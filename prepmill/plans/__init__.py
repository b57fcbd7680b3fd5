"""Registered queries over the test tables, each with its SQL check where one exists."""

from importlib import import_module

MODULES = (
    "sources", "profile", "views", "shape", "repair", "charts", "advice", "setup", "features", "evaluation",
    "training", "explaining", "packaging",
)


def load_all() -> None:
    """Import every plan module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
