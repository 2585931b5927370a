"""Rewriting of references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlake.functions import urls


def alternate_href(ref: Column, base: Column, local: str | None = None) -> Column:
    """A language alternate's address: of the same origin, its path below ``local`` (or
    alone, if that is absent or the same origin); of another one, unchanged."""
    whole = urls.resolve_simple(ref, base)
    same = F.coalesce(urls.origin(whole) == urls.origin(base), F.lit(False))
    path = urls.path_only(whole)
    if not local:
        return F.when(same, path).otherwise(ref)
    root = F.lit(local.rstrip("/"))
    return F.when(same & (root == urls.origin(base)), path).when(same, F.concat(root, path)).otherwise(ref)
