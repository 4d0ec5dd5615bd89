"""Secret scans with corpus-wide ownership frequency.

Candidates are the base patterns (assignments, access keys, long hex runs) and a wider set of credential shapes. The
hash of each candidate's value is counted over the whole corpus by distinct repositories and owners, pre-aggregated
before any shuffle of pairs. A value of few owners and few of their repositories looks live and is reported; one that
many owners share, or that an owner has all over, is an example that has been copied, and of such values only base
spans are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Covered, materialize

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex"]

#: Further shapes, as kind "live" where few owners have the value: URL credentials, prefixed keys, signed tokens, key blocks.
WIDER = re.compile(
    r"(?<=://)[A-Za-z0-9._-]++:[^\s:@/]{6,}+(?=@)"
    r"|(?<![A-Za-z0-9_])(?:gh[opsu]_|glpat-|sk_live_|rk_live_|xox[abp]-)[A-Za-z0-9_-]{16,}+"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY-----"
)
_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_MARKS = ("://", "ghp_", "gho_", "ghs_", "ghu_", "glpat-", "_live_", "xox", "eyJ", "-----BEGIN ")
#: A value of more owners than this, or in more repositories of an owner than this on average, counts as widely copied.
MAX_OWNERS, MAX_REPOS = 2, 100


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base candidates, then of wider ones that overlap none of them."""
    found = []
    low = text.lower()
    if any(x in low for x in _WORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    if any(x in text for x in _MARKS):
        base = Covered((a, b) for _, a, b, _ in found)
        found += [("live", *m.span(), m[0]) for m in WIDER.finditer(text) if not base.meets(*m.span())]
    return found


def candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """(row, doc_id, repo, owner, found): the candidates of each row; row numbers rows, as doc_id may repeat."""
    docs = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.col("text").cast("string").alias("text"),
    )
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "value"), x)) for x in find(t)] if t else [] for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(item))], names=["row", "doc_id", "repo", "owner", "found"])

    schema = "row long, doc_id long, repo string, owner string, found array<struct<kind string, start long, end long, value string>>"
    return docs.mapInArrow(run, schema)


def ownership(cands: DataFrame) -> DataFrame:
    """(value_sha256, repos, owners) of every value: distinct repositories and owners that have it.

    A repository without an owner counts as an owner of its own, so that copies of unknown owners count as copies; rows
    with neither count as one together.
    """
    known = F.coalesce(F.concat(F.lit("o"), F.col("owner")), F.concat(F.lit("r"), F.col("repo")), F.lit("")).alias("owner")
    each = cands.select(F.coalesce("repo", F.lit("")).alias("repo"), known, F.explode("found.value").alias("value")).select(F.sha2("value", 256).alias("value_sha256"), "repo", "owner")
    pairs = each.groupBy("value_sha256", "repo", "owner").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_sha256", "owner").agg(F.count_distinct("repo").alias("repos"))
    # repositories belong to one owner each here; a repository id of several owners counts once for each
    return owners.groupBy("value_sha256").agg(F.sum("repos").alias("repos"), F.count("owner").alias("owners"))


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(doc_id, spans) for every row: an array of structs (kind, start, end, value_sha256, repos, owners, live).

    start and end count code points. Base spans (assign, access, hex) are always there; spans of kind "live" only where
    at most max_owners owners have the value, in at most max_repos repositories for each. live says the same of each span.
    Null and empty texts have no spans; rows that repeat a doc_id give a row each, an empty table gives none. Other columns
    of docs are ignored. Texts and values of any length are taken whole.
    """
    cands = materialize(candidates(docs, repo, owner), "candidates")
    own = ownership(cands)
    each = cands.select("row", F.explode("found").alias("x")).select("row", "x.*").withColumn("value_sha256", F.sha2("value", 256))
    each = each.join(own, "value_sha256").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos * F.col("owners"))).where("kind <> 'live' or live")
    order = F.array_position(F.array(*map(F.lit, [*KINDS, "live"])), F.col("kind")).cast("int")
    spans = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("rank"), "kind", "end", "value_sha256", "repos", "owners", "live"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start: long, rank: int, kind: string, end: long, value_sha256: string, repos: long, owners: long, live: boolean>>)")
    return cands.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _is(kind: str, span: F.Column) -> F.Column:
    return span["kind"] == kind


def digest(spans: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans, in order of start and kind, as text."""

    def text(kinds: list[str] | None) -> F.Column:
        chosen = F.filter("spans", lambda s: s["kind"].isin(kinds)) if kinds else F.col("spans")
        return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    counts = [F.size(F.filter("spans", partial(_is, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return spans.select("doc_id", *counts, F.sha2(text(KINDS), 256).alias("base_sha256"), text(None).alias("spans"), more)
