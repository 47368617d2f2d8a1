"""Secret scan with multipart credential linking.

Strong findings stand alone: assigned secrets, access identifiers of a fixed
format and long hexadecimal keys (``BASE_KINDS``).  Weak parts are common in
clean text, so they are reported only when complementary parts co-occur: an
interval join links identifiers, opaque secrets and endpoints of one scope (a
paragraph) whose intervals, widened by ``REACH`` characters, overlap.

  secret    is reported when an identifier or an endpoint is linked to it
  ident     is reported when a secret is linked to it
  endpoint  is reported when a secret is linked to it

Narrow: one pass, no shuffle; the join is a sorted search within one text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.shared import ship_package

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("ident", "secret", "endpoint")
#: characters by which a part's interval is widened on either side
REACH = 200
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones fail alike
_IDENT = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:name)?|login)["']?"""
                    r"""\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}""")
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

FIELDS = ("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
          "n_ident bigint, n_secret bigint, n_endpoint bigint, found array<struct<kind:string,start:bigint,end:bigint>>")
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TYPE = pa.struct([(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")]
                  + [("base_sha256", pa.string()), ("spans", pa.string())]
                  + [(n, pa.int64()) for n in ("n_ident", "n_secret", "n_endpoint")] + [("found", _FOUND)])

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Strong findings by kind, as code point intervals of whole matches."""
    out: dict[str, list[Span]] = {"assign": [], "access": [], "hex": [m.span() for m in _HEX.finditer(text)]}
    if ":" in text or "=" in text:
        out["assign"] = [m.span() for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out["access"] = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def _opaque(token: str) -> bool:
    """Mixed letters of either case and digits: not a word, a number or a path."""
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _linked(parts: list[Span], others: list[Span], scopes: list[int], reach: int) -> list[Span]:
    """Parts that have one of ``others`` (sorted, disjoint) in their scope within ``reach`` on either side."""
    starts, ends = [s for s, _ in others], [e for _, e in others]
    out = []
    for s, e in parts:
        scope = bisect_right(scopes, s)
        # others are disjoint, so those that overlap [s - reach, e + reach) are consecutive
        lo, hi = bisect_right(ends, s - reach), bisect_left(starts, e + reach)
        if lo < hi and (bisect_right(scopes, starts[lo]) <= scope <= bisect_right(scopes, starts[hi - 1])):
            if any(bisect_right(scopes, starts[i]) == scope for i in _near(starts, lo, hi, s)):
                out.append((s, e))
    return out


def _near(starts: list[int], lo: int, hi: int, at: int) -> tuple[int, ...]:
    """The neighbours of ``at`` among lo..hi-1; scopes are intervals, so a partner in scope is one of them."""
    i = bisect_left(starts, at, lo, hi)
    return tuple(j for j in (i - 1, i) if lo <= j < hi)


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap none of ``taken``."""
    taken = sorted(taken)
    ends = []
    high = -1
    for _, e in taken:
        high = max(high, e)
        ends.append(high)
    starts = [s for s, _ in taken]
    return [(s, e) for s, e in spans if (i := bisect_left(starts, e)) == 0 or ends[i - 1] <= s]


def linked_spans(text: str, base: dict[str, list[Span]], reach: int = REACH) -> dict[str, list[Span]]:
    """Weak parts that complementary parts of their scope confirm."""
    none: dict[str, list[Span]] = {k: [] for k in WEAK_KINDS}
    strong = [s for k in BASE_KINDS for s in base[k]]
    secrets = _apart([m.span() for m in _SECRET.finditer(text) if _opaque(m.group())], strong)
    strong_secrets = sorted(_apart(base["hex"], base["assign"]) + base["assign"])
    if not secrets and not strong_secrets:
        return none
    idents = [m.span() for m in _IDENT.finditer(text)] if ":" in text or "=" in text else []
    idents = _apart(idents, strong)
    ends = [m.span() for m in _ENDPOINT.finditer(text)] if ":" in text else []
    ends = _apart(ends, strong)
    secrets = _apart(secrets, ends + idents)
    scopes = [m.end() for m in _SCOPE_END.finditer(text)]
    all_idents = sorted(idents + base["access"])
    all_secrets = sorted(secrets + strong_secrets)
    by_ident = _linked(secrets, all_idents, scopes, reach)
    by_end = _linked(secrets, ends, scopes, reach)
    return {"ident": _linked(idents, all_secrets, scopes, reach),
            "secret": sorted({*by_ident, *by_end}),
            "endpoint": _linked(ends, all_secrets, scopes, reach)}


def render(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Spans by start, then kind as listed, then end."""
    return [(kinds[k], s, e) for s, k, e in sorted((s, k, e) for k, kind in enumerate(kinds) for s, e in spans[kind])]


def scan(text: str, reach: int = REACH) -> dict:
    """One row of ``FIELDS``."""
    base = base_spans(text)
    spans = base | linked_spans(text, base, reach)
    line = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    found = render(spans, BASE_KINDS + WEAK_KINDS)
    return {f"n_{k}": len(v) for k, v in spans.items()} | {
        "base_sha256": hashlib.sha256(line(render(base, BASE_KINDS)).encode()).hexdigest(), "spans": line(found),
        "found": [{"kind": k, "start": s, "end": e} for k, s, e in found]}


def credential_spans(text: Column, reach: int = REACH) -> Column:
    """Struct column (``FIELDS``) of a text column; a null text counts as empty (no spans)."""
    ship_package()

    @F.arrow_udf(FIELDS)
    def find(col: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py() or "", reach) for t in col], _TYPE)

    return find.asNondeterministic()(text)


def scan_documents(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """All columns of ``docs`` plus a struct column ``credentials`` (a column of that name is replaced)."""
    return docs.withColumn("credentials", credential_spans(F.col(text_col), reach))
