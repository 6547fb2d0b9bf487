"""Secret scans: keyword automaton, anchored expressions near its hits, then checksums.

An Aho-Corasick automaton runs over each whole text once. Only where it reports a keyword is
an expression matched, anchored at the hit, and tokens that carry a checksum of their own
must satisfy it. Long runs of hexadecimal digits have no keyword; a plain expression finds
them. Text is matched as UTF-8 bytes and offsets are given in code points.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import append_columns, aside

#: The kinds in their order. github and npm tokens end in six base-62 digits of a CRC-32.
KINDS = ("assign", "access", "hex", "github", "npm")
PLACEHOLDER = "[SECRET]"

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")}
_KEYWORDS |= {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
FINDINGS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the body's CRC-32, zeros in front."""
    n, out = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0").encode()


@lru_cache(1)
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; offsets in code points, end exclusive."""
    if not text:
        return []
    data = text.encode("utf-8", "replace")
    hits: dict[str, set[int]] = {}
    # Latin-1 gives each byte a character of its own, so that the automaton's places are byte offsets
    for end, (size, kind) in _automaton().iter(data.lower().decode("latin-1")):
        hits.setdefault(kind, set()).add(end - size + 1)
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(data)]
    for kind, starts in hits.items():
        rank, over = KINDS.index(kind), 0
        for at in sorted(starts):
            if at < over:
                continue
            m = (_ASSIGN if rank == 0 else _ACCESS if rank == 1 else _CHECKED).match(data, at)
            if not m:
                continue
            over = m.end()
            if rank == 0:
                good = len(m[2]) >= 12
            elif rank == 1:
                good = over - at >= 18
            else:
                good = checksum(m[1]) == m[2]
            if good:
                found.append((at, rank, over))
    found.sort()
    if found and len(data) != len(text):
        place = {}
        last = count = 0
        for at in sorted({x for s, _, e in found for x in (s, e)}):
            count += len(data[last:at].decode())
            place[at], last = count, at
        found = [(place[s], k, place[e]) for s, k, e in found]
    return [(KINDS[k], s, e) for s, k, e in found]


def mask(text: str | None, placeholder: str = PLACEHOLDER) -> str | None:
    """The text with each stretch of touching or overlapping findings replaced; null stays null."""
    spans = sorted((s, e) for _, s, e in find(text))
    if not spans:
        return text
    out, at = [], 0
    s0, e0 = spans[0]
    for s, e in [*spans[1:], (len(text) + 1, 0)]:
        if s <= e0:
            e0 = max(e0, e)
        else:
            out += [text[at:s0], placeholder]
            at, s0, e0 = e0, s, e
    return "".join([*out, text[at:]])


def scan(df: DataFrame, column: str = "text", into: str = "findings") -> DataFrame:
    """Adds `into`, the findings of each whole text (kind, start, end).

    Null and empty texts have none. A column of that name is replaced; rows, repeated ones
    included, and all other columns stay.
    """

    def make(texts: list[str | None]) -> list:
        return [[[dict(zip(("kind", "start", "end"), x)) for x in find(t)] for t in texts]]

    return append_columns(df, column, make, [T.StructField(into, FINDINGS)])


def redact(df: DataFrame, column: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """df with all findings in `column` replaced by the placeholder; every row and every other column stays; a null stays null."""
    df, back = aside(df, ["__masked"])
    made = append_columns(
        df, column, lambda texts: [[mask(t, placeholder) for t in texts]], [T.StructField("__masked", T.StringType())]
    )
    return back(made.drop(column).withColumnRenamed("__masked", column))


def report(documents: DataFrame) -> DataFrame:
    """Per document: counts of the three base kinds, their digest, and all spans.

    Null and empty texts have none; repeated rows have equal results; other columns are not looked at.
    """
    shown = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(*KINDS[:3]))
    return scan(documents.select("doc_id", "text")).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"),
    )
