"""Secret scan: strong findings by pattern, weak candidates by the parts that occur with them.

One pass over the texts finds, by pattern, the base findings

- assign: a keyword, an equals sign or colon, and a value of 12 characters or more (`ASSIGN`),
- access: AKIA and 14 or more capitals and digits,
- hex: 16 or more lower-case hexadecimal digits,

and weak candidates, none of which overlaps a base finding or another candidate (`WEAK`):

- id: an account, user, client or access-key identifier, or a short AKIA run;
- key: a named secret too short or too plain for `assign`, or a bare run of 40 base64 characters with capitals, small
  letters and digits;
- endpoint: a URL with a scheme, or a named host.

A candidate alone is noise.  It is reported only where complementary parts co-occur: an id with a secret (assign, key
or hex), a key with an identifier (access or id) or an endpoint, an endpoint with a secret (assign or key) and an
identifier.  Parts co-occur if they lie in the same scope, a stretch of text between blank lines, section headers
(`[...]`) and `---` lines, and one begins within `reach` characters of the other's extent.

That is an interval join: each candidate's interval, its extent widened by `reach`, meets the starts of the other
parts.  Parts are counted into zones, one for each (row, scope, start // reach), which keep the first and last start of
each role; a candidate is sent to the few zones that its interval touches.  A zone inside the interval holds the role
or doesn't, and in the zones at its two ends the last or first start decides, so no pair of parts is spelled out,
however many a scope holds.  Only candidates of documents that hold complementary roles are joined, and no text is
shuffled; all other rows pass straight through.

A null text counts as empty.  Null and repeated ids, and repeated rows, are rows of their own.  Only id and text are
read, so other columns may have any name.  An empty table gives no rows.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import batches, written

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
_BASE_WORDS = "password|passwd|secret|token|api_?key"
_IS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = re.compile(rf"({_BASE_WORDS}){_IS}([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
_IDS = "access_?key_?id|client_?id|account(?:_?(?:id|name))?|user(?:_?(?:name|id))?|login"
_KEYS = f"pwd|pass|passphrase|passcode|private_?key|auth|credentials?|{_BASE_WORDS}"
WEAK = re.compile(
    rf"""(?P<endpoint>[a-z][a-z0-9+.-]{{1,15}}://[^\s"'<>]+|(?<![a-z0-9])(?:host(?:name)?|endpoint|server){_IS}[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::[0-9]+)?)
    |(?P<id>(?<![a-z0-9])(?:{_IDS}){_IS}[a-z0-9_.@+-]{{3,}}|(?-i:AKIA[A-Z0-9]{{4,}}))
    |(?P<key>(?<![a-z0-9])(?:{_KEYS}){_IS}[^\s"',;]{{4,}}|(?<![a-z0-9/+=])[a-z0-9/+]{{40}}(?![a-z0-9/+=]))""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
SCOPE_ENDS = re.compile(r"\n[ \t\r]*(?=\n)|\n(?=\[[^\]\n]*\])|\n(?=---)")
#: What a text has to hold to be worth a look; a superset of the patterns above, for the vectorised matcher.
_ANY = rf"""(?:{_BASE_WORDS}|{_KEYS}){_IS}|[A-Za-z0-9/+]{{40}}|(?-i:AKIA[A-Z0-9]{{4}}|[0-9a-f]{{16}})""".replace("(?:", "(")
_PART = "struct<start:int,kind:int,end:int,scope:int>"
#: Roles: identifier, secret, endpoint, digest (hex, a secret to identifiers only).
_ROLES = ("secret", "identifier", "digest", "identifier", "secret", "endpoint")


def _mixed(run: str) -> bool:
    return bool(re.search("[A-Z]", run) and re.search("[a-z]", run) and re.search("[0-9]", run))


def found_in(text: str) -> list[tuple[int, int, int]]:
    """Base findings and weak candidates of a text as (start, kind, end), by start."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    covered = sorted((s, e) for s, _, e in out)
    starts, ends = [s for s, _ in covered], list(np.maximum.accumulate([e for _, e in covered] or [0]))
    for m in WEAK.finditer(text):
        kind = KINDS.index(m.lastgroup)
        before = int(np.searchsorted(starts, m.end()))  # base findings that begin before its end
        if before and ends[before - 1] > m.start():
            continue
        if kind == 4 and m.end() - m.start() == 40 and not re.search("[:=]", m.group()) and not _mixed(m.group()):
            continue
        out.append((m.start(), kind, m.end()))
    return sorted(out)


def _find(frames):
    fields = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())])
    for b in batches(frames):
        text = b.column(1).fill_null("")
        look = pc.match_substring_regex(text, _ANY, ignore_case=True)
        parts: list[list] = [[] for _ in range(b.num_rows)]
        for i in np.flatnonzero(look.to_numpy(zero_copy_only=False)):
            own = text[int(i)].as_py()
            if found := found_in(own):
                scopes = np.searchsorted([m.start() for m in SCOPE_ENDS.finditer(own)], [f[0] for f in found])
                parts[i] = [(*f, int(s)) for f, s in zip(found, scopes, strict=True)]
        kinds = [pa.array([p[j] for x in parts for p in x], pa.int32()) for j in range(4)]
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(kinds, fields=list(fields)))], names=["id", "parts"])


def _role(name: str, kind: Column) -> Column:
    return kind.isin([i for i, r in enumerate(_ROLES) if r == name])


def linked(found: DataFrame, reach: int) -> DataFrame:
    """row, start, kind and end of the candidates (row, part) that have their complements; found has row and parts."""
    parts = found.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    at = lambda name: F.when(_role(name, F.col("kind")), F.col("start"))
    roles = sorted(set(_ROLES))
    ends = [f(at(r)).alias(f"{r}_{n}") for r in roles for f, n in ((F.min, "first"), (F.max, "last"))]
    zones = parts.groupBy("row", "scope", F.floor(F.col("start") / reach).alias("zone")).agg(*ends)
    weak = parts.where("kind >= 3").withColumns({"low": F.col("start") - reach, "high": F.col("end") + reach})
    sent = weak.withColumn("zone", F.explode(F.sequence(F.floor(F.col("low") / reach), F.floor(F.col("high") / reach))))
    met = sent.join(zones, ["row", "scope", "zone"])
    has = [F.max((F.col(f"{r}_first") <= F.col("high")) & (F.col(f"{r}_last") >= F.col("low"))).alias(r) for r in roles]
    near = met.groupBy("row", "start", "kind", "end").agg(*[F.coalesce(h, F.lit(False)).alias(r) for h, r in zip(has, roles, strict=True)])
    secret, identifier, digest, endpoint = (F.col(r) for r in ("secret", "identifier", "digest", "endpoint"))
    complete = F.when(F.col("kind") == 3, secret | digest).when(F.col("kind") == 4, identifier | endpoint).otherwise(secret & identifier)
    return near.where(complete).select("row", "start", "kind", "end")


def scan(docs: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans: arrays of (start, kind, end) in order, kind being a place in KINDS; spans holds the base ones too."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_find, f"id {kind}, parts array<{_PART}>")
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "id", "parts"), "found")
    bare = lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))
    base = F.transform(F.filter("parts", lambda p: p["kind"] < 3), bare)
    holds = lambda *kinds: F.exists("parts", lambda p: p["kind"].isin(*kinds))
    possible = holds(3) & holds(0, 2, 4) | holds(4) & holds(1, 3, 5) | holds(5) & holds(0, 4) & holds(1, 3)
    some = found.where(possible)
    added = linked(some, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))  # of one text
    with_added = some.join(added, "row", "left").select("id", base.alias("base"), F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))
    whole = with_added.select("id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))
    rest = found.where(~possible).select("id", base.alias("base")).withColumn("spans", F.col("base"))
    return rest.unionByName(whole).withColumnRenamed("id", id_col)


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
