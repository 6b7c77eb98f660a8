"""Registered queries over the driver's tables (see ``registry.py``)."""


def all_queries():
    from . import q_catalog, q_html, q_images, q_quality, q_scalars, q_stages, q_urls  # noqa: F401  (registers on import)
    from .registry import REGISTRY
    return dict(REGISTRY)
