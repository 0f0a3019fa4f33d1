"""Secret scan by multipart credential linking.

A text is read once, inside the task that holds it. Base spans (keyword assignments, access keys, long
hexadecimal runs) are always reported. Weak candidates - short access keys, named identifiers, short or
bare secrets, service addresses and what they hold - become intervals that are joined inside their scope (a
block of lines without an empty line between): a weak secret needs an identifier or an address within ``GAP``
code points, an identifier or an address needs a secret. All parts take part in the join; overlaps are resolved
among those that it leaves.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import chunked, runs, table

#: Kinds in the order of the digest; the first three are the base.
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: Most code points between two parts of one credential.
GAP = 200
#: Bits a character of a bare secret.
MIN_ENTROPY = 3.2

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMED = re.compile(r"""(?ai)\b(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""")
ADDRESS = re.compile(r"""(?ai)\b(?:https?|ftp|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s"'<>]+""")
USERINFO = re.compile(r"""://([^\s:/@"'<>]+):([^\s/@"'<>]+)@""")
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
SCOPE_END = re.compile(r"\n[\x20\t]*\n")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("text", pa.string())]))

_hex = np.zeros(256, bool)
_hex[list(b"0123456789abcdef")] = True
_token = np.zeros(256, bool)
_token[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_digit = np.zeros(256, bool)
_digit[list(b"0123456789")] = True


def _random_looking(s: str) -> bool:
    if not (re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)):
        return False
    _, n = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum()) >= MIN_ENTROPY


def _long_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a hexadecimal run of 32, and with a token of 20 that holds a digit."""
    hexes, bare = np.zeros(len(column), bool), np.zeros(len(column), bool)
    for lo, _, data, at in chunked(column):
        start, end, row = runs(_hex[data], at)
        hexes[lo + row[end - start >= 32]] = True
        start, end, row = runs(_token[data], at)
        long = end - start >= 20
        digits = np.concatenate(([0], np.cumsum(_digit[data])))
        bare[lo + row[long & (digits[end] > digits[start])]] = True
    return hexes, bare


def _parts(text: str, has_hex: bool, has_bare: bool) -> tuple[list, list]:
    """Base spans and weak parts of one text as (kind, start, end)."""
    base, weak = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            (base if m.end(2) - m.start(2) >= 8 else weak).append(("assign" if m.end(2) - m.start(2) >= 8 else "secret", m.start(), m.end()))
        weak += [("identifier", m.start(), m.end()) for m in NAMED.finditer(text)]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            strong = m.end() - m.start() >= 16
            (base if strong else weak).append(("access" if strong else "identifier", m.start(), m.end()))
    if has_hex:
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    addresses = []
    if "://" in text:
        addresses = [(m.start(), m.end()) for m in ADDRESS.finditer(text)]
        weak += [("endpoint", s, e) for s, e in addresses]
        for s, e in addresses:
            if m := USERINFO.search(text, s, e):
                weak += [("identifier", *m.span(1)), ("secret", *m.span(2))]
    if has_bare:
        for m in BARE.finditer(text):
            if _random_looking(m.group()):
                k = bisect.bisect_right(addresses, (m.start(), len(text))) - 1
                # A random piece of a path is no secret of the address around it; an identifier may make it one.
                weak.append(("piece" if k >= 0 and m.end() <= addresses[k][1] else "secret", m.start(), m.end()))
    return base, weak


def _uncovered(base: list, weak: list) -> list:
    """Weak parts that no base span overlaps; an address may hold base spans."""
    spans = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    out = []
    for kind, s, e in weak:
        k = bisect.bisect_left(starts, s if kind == "endpoint" else e) - 1
        if k < 0 or reach[k] <= s:
            out.append((kind, s, e))
    return out


def _resolved(parts: list) -> list:
    """Linked parts (start, end, kind) without overlaps: the earlier one stays, of two with one start the longer; parts
    inside an address stay beside it."""
    out, reach = [], -1
    for s, e, kind in sorted(set(parts), key=lambda p: (p[0], -p[1], p[2])):
        if kind == "endpoint":
            out.append((s, e, kind))
        elif s >= reach:
            out.append((s, e, kind))
            reach = e
    return out


def _near(query: np.ndarray, other: np.ndarray, gap: int) -> np.ndarray:
    """For each (scope, start, end): whether an interval of ``other`` of the same scope lies within the gap.

    Of a scope's intervals, those that begin up to end + gap less those that end before start - gap."""
    if not len(query) or not len(other):
        return np.zeros(len(query), bool)
    wide = np.int64(max(query[:, 2].max(), other[:, 2].max()) + 2 * gap + 2)
    key = lambda scope, at: scope * wide + np.clip(at + gap, 0, wide - 1)
    starts, ends = np.sort(key(other[:, 0], other[:, 1])), np.sort(key(other[:, 0], other[:, 2]))
    begun = np.searchsorted(starts, key(query[:, 0], query[:, 2] + gap), "right")
    over = np.searchsorted(ends, key(query[:, 0], query[:, 1] - gap), "left")
    return begun > over


def _link(base: list, weak: list, gap: int) -> list:
    """Interval join of all parts of a batch, each (scope, start, end, kind, ...); the weak parts that stay."""
    array = lambda parts: np.array([p[:3] for p in parts], np.int64).reshape(-1, 3)
    of = lambda *kinds: [p for p in weak if p[3] in kinds]
    secret = [p for p in base if p[3] in ("assign", "hex")] + of("secret")
    identifier = [p for p in base if p[3] == "access"] + of("identifier")
    out = []
    for kind, other in (("secret", identifier + of("endpoint")), ("piece", identifier), ("endpoint", secret), ("identifier", secret + of("piece"))):
        parts = of(kind)
        out += [p for p, yes in zip(parts, _near(array(parts), array(other), gap), strict=True) if yes]
    return out


def _scan(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hexes, bare = _long_runs(batch.column(1))
        n, scope = batch.num_rows, 0
        spans: list[list] = [[] for _ in range(n)]
        base_parts, weak_parts = [], []
        column = batch.column(1)
        for r in range(n):
            text = column[r].as_py() or ""
            base, weak = _parts(text, hexes[r], bare[r])
            if not base and not weak:
                continue
            ends = [m.start() for m in SCOPE_END.finditer(text)]
            place = lambda kind, s, e: (scope + bisect.bisect_left(ends, s), s, e, kind, r)  # noqa: E731, B023
            base_parts += [place(*p) for p in base]
            weak_parts += [place(*p) for p in _uncovered(base, weak)]
            scope += len(ends) + 1
        linked: dict[int, list] = {}
        for _, s, e, kind, r in _link(base_parts, weak_parts, gap):
            linked.setdefault(r, []).append((s, e, "secret" if kind == "piece" else kind))
        for _, s, e, kind, r in base_parts:
            spans[r].append((s, KINDS.index(kind), e, True))
        for r, parts in linked.items():
            spans[r] += [(s, KINDS.index(kind), e, False) for s, e, kind in _resolved(parts)]
        full = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "text": column[r].as_py()[s:e]} for s, k, e, b in sorted(x)] for r, x in enumerate(spans)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, SPANS)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc_id, spans): every span as kind, start, end (code points, end exclusive), base, text, by start and kind.

    NULL and empty texts have no spans; a NULL id stays NULL; repeated rows give repeated rows; other columns
    are ignored. One pass without a shuffle: memory is bounded by an Arrow batch."""
    schema = "doc_id bigint, spans array<struct<kind string, start bigint, end bigint, base boolean, text string>>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(partial(_scan, gap=gap), schema)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.base)
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s.base)).cast("bigint").alias("n_linked"))
