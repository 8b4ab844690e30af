"""Registered queries: one per operator, each over the given tables or tables derived from them."""


def load():
    """Import every query module and return (queries, oracles)."""
    import importlib
    import pkgutil

    from phonrisk.suite import registry

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{mod}")
    return registry.QUERIES, registry.ORACLES
