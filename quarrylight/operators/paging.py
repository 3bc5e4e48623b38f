"""Pages, cursors, hit totals, and how a request is resolved to a mode and a sort. All on the driver, but the totals."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION, MAX_CHARS, MAX_ID, MAX_LONG = 1, 4096, 2**31 - 1, 2**63 - 1
WINDOW = 10_000


def encode_cursor(direction: str, values: list, position: int, total: int | None = None, lower_bound: bool = False) -> str:
    raw = json.dumps([VERSION, direction, values, position, total, lower_bound], separators=(",", ":"), allow_nan=False)
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(text: str, kinds: list[str]) -> dict:
    """The parts of a cursor; kinds: str, int, float or id for each sort value. Anything else is an error."""
    if len(text) > MAX_CHARS:
        raise ValueError("cursor is too long")
    try:
        version, direction, values, position, total, lower = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, TypeError) as e:
        raise ValueError("cursor cannot be read") from e
    if version != VERSION or direction not in ("after", "before") or not isinstance(values, list) or len(values) != len(kinds):
        raise ValueError("cursor is of another search")

    def ok(v, kind: str) -> bool:
        if v is None:
            return kind != "id"
        if isinstance(v, bool):
            return False
        if kind == "str":
            return isinstance(v, str)
        if kind == "float":
            return isinstance(v, (int, float)) and math.isfinite(v)
        return isinstance(v, int) and (1 <= v <= MAX_ID if kind == "id" else abs(v) <= MAX_LONG)

    counts = [x for x in (position, total) if x is not None]
    if not all(ok(v, k) for v, k in zip(values, kinds, strict=True)) or any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for x in counts) or position is None:
        raise ValueError("cursor has values of another kind")
    return {"direction": direction, "values": values, "position": position, "total": total, "lower_bound": bool(lower)}


def envelope(total: int, page: int, size: int) -> dict:
    return {"page": page, "page_size": size, "total": total, "has_more": page * size < total, "total_pages": max(1, -(-total // size))}


def check_window(offset: int, limit: int, most: int = 100, window: int = WINDOW) -> None:
    if not 0 < limit <= most or offset < 0 or offset + limit > window:
        raise ValueError(f"limit is at most {most}, and offset + limit {window}")


def hit_total(df: DataFrame, cap: int | None = None) -> DataFrame:
    """One row (found, found_is_lower_bound): the exact total, or a count that stops beyond `cap` rows."""
    if cap is None:
        return df.agg(F.count("*").alias("found")).select("found", F.lit(False).alias("found_is_lower_bound"))
    n = F.count("*")
    return df.limit(cap + 1).agg(F.least(n, F.lit(cap)).alias("found"), (n > cap).alias("found_is_lower_bound"))


def ranked_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page with each row's rank over all pages."""
    from pyspark.sql.window import Window

    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)  # a page is of bounded size


def truncated(mode: str, found: int, window: int = WINDOW) -> bool:
    return mode != "browse" and found > window


def adjusted_sort(sort: str | None, query: str | None, strict: bool = False) -> tuple[str, list[str]]:
    """The sort of a request and its warnings: relevance needs a query."""
    if not sort:
        return ("relevance" if query else "title"), []
    if sort == "relevance" and not query:
        if strict:
            raise ValueError("relevance needs a query")
        return "title", ["sort_adjusted"]
    return sort, []


def resolve_mode(mode: str, query: str | None, available: set[str], embedding_ok: bool = True) -> tuple[str, list[str]]:
    """The executor of a request and its warnings. auto: browse without a query, lexical for quotes, else the best that is there; a failed embedding falls back to lexical only then."""
    if mode != "auto":
        if mode not in available | {"browse"}:
            raise ValueError(f"mode {mode} is not available")
        if mode in ("semantic", "hybrid") and not embedding_ok:
            raise ValueError("the query could not be embedded")
        return mode, []
    if not (query or "").strip():
        return "browse", []
    if '"' in query and "lexical" in available:
        return "lexical", []
    best = next((m for m in ("hybrid", "lexical", "semantic") if m in available), None)
    if best is None:
        raise ValueError("no search mode is available")
    if best != "lexical" and not embedding_ok:
        if "lexical" in available:
            return "lexical", ["semantic_unavailable"]
        raise ValueError("the query could not be embedded")
    return best, []
