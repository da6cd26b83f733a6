"""Named queries over the driver tables, each with an independent oracle."""

_MODULES = ["q_text", "q_relational", "q_vectors", "q_patterns", "q_models"]


def load_all() -> None:
    import importlib
    for m in _MODULES:
        importlib.import_module(f"textmill.plans.{m}")
