"""Secret scans weighed by how many owners a candidate has in the whole corpus.

Base spans come from fixed patterns; further candidates from the formats of well-known tokens, private keys and long random strings. Each candidate's text is hashed,
and the hashes are aggregated over the corpus: in how many distinct repositories and by how many distinct owners each occurs. What many owners have, or what several
have in many repositories, is an example that was copied; what one owner has, in however many repositories, or a few in few, is live-looking. The verdict
decides which further candidates are added as spans, and labels base spans, which all stay. A repository is a column's value or, where none is
named, a distinct text, so that exact copies of a text count once.

Only candidates are shuffled, never texts. Counts are of distinct (hash, owner) and (hash, repository) pairs made before the final aggregation, and the verdicts are
one row a hash: the partition of an example that a third of all rows hold is one that adaptive execution splits in the join.

Edge cases: a null text counts as empty; a text without candidates has zero counts, the hash of the empty string and ""; a null
owner is an owner of its own, as is a null repository; repeated rows each get their row and are one repository; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty, written

#: Fixed base patterns, each with the group that is measured and its least length. A run below the length can't hold another match.
BASE = {
    "assign": (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Formats of further candidates.
EXTRA = {
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
    "web_token": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "vendor": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})"),
    "url_login": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
#: What a text must contain for a pattern to be tried.
NEEDS = {
    "assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)"), "access": re.compile("AKIA"), "private_key": re.compile("PRIVATE KEY-----"),
    "web_token": re.compile("eyJ"), "vendor": re.compile("gh[pousr]_|github_pat_|glpat-|xox|sk_live_|AIza|npm_"), "url_login": re.compile("://"),
}
KINDS = (*BASE, *EXTRA)
#: Owners from which on a candidate is an example, repositories from which on it is one where it has more than one owner, and bits a character that a random string has at least.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, RANDOM_BITS = 3, 10, 4.0


def entropy(s: str) -> float:
    """Bits a character of a string's own distribution of characters."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def key_words(text: str) -> bool:
    lower = text.lower()
    return "pass" in lower or "secret" in lower or "token" in lower or "api" in lower


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of the kind, end, the secret itself) of every base span and further candidate in a whole text."""
    out = []
    for number, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind == "assign" and not key_words(text) or kind == "access" and "AKIA" not in text:
            continue
        out += [(m.start(), number, m.end(), m.group(group)) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    starts, ends = map(list, zip(*sorted((s, e) for s, _, e, _ in out), strict=True)) if out else ([], [])
    reach = list(accumulate(ends, max))
    for number, (kind, pattern) in enumerate(EXTRA.items(), len(BASE)):
        if kind in NEEDS and not NEEDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            s, e, secret = m.start(), m.end(), m.group(1) if pattern.groups else m.group()
            before = bisect_left(starts, e)  # base spans that begin before this one ends
            if before and reach[before - 1] > s:
                continue
            if kind == "random" and (entropy(secret) < RANDOM_BITS or not (re.search("[0-9]", secret) and re.search("[a-z]", secret) and re.search("[A-Z]", secret))):
                continue
            out.append((s, number, e, secret))
    return sorted(out)


def scan(docs: DataFrame, owner: str | None = "source", id_col: str = "doc_id", text_col: str = "text", repository: str | None = None) -> DataFrame:
    """doc_id, owner, repository (a hash of the column of that name or of the text) and found, an array of kind, s, e and hash of the secret, for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch.pop("text").tolist():
                found.append([{"kind": k, "s": s, "e": e, "hash": hashlib.sha256(x.encode()).hexdigest()} for s, k, e, x in candidates(text)])
            batch["found"] = found
            yield batch

    named = F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")
    of = F.xxhash64(text_or_empty(text_col)) if repository is None else F.xxhash64(F.col(repository).cast("string"))
    given = small_batches(docs).select(F.col(id_col).alias("doc_id"), named.alias("owner"), of.alias("repository"), text_or_empty(text_col).alias("text"))
    return map_rows(given, run, "owner string, repository long, found array<struct<kind:int,s:int,e:int,hash:string>>")


def ownership(rows: DataFrame) -> DataFrame:
    """hash, owners and repositories of every candidate in the corpus."""
    each = rows.select("owner", "repository", F.explode("found").alias("c")).select("c.hash", F.coalesce("owner", F.lit("\0")).alias("owner"), "repository")
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    copies = each.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(copies, "hash")


def judged(rows: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """row, kind, s, e, hash, owners, repositories and verdict (example or live) of each candidate in ``rows``."""
    each = rows.select("row", F.explode("found").alias("c")).select("row", "c.*")
    copied = (F.col("owners") >= example_owners) | (F.col("owners") > 1) & (F.col("repositories") >= example_repositories)
    return each.join(ownership(rows), "hash").withColumn("verdict", F.when(copied, "example").otherwise("live"))


def secrets(docs: DataFrame, owner: str | None = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, repository: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_added, n_live, n_example, n_spans, and the most owners and repositories that a span's secret has, of every row of ``docs``."""
    rows = written(scan(docs, owner, repository=repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    names = F.array(*map(F.lit, KINDS))
    spans = judged(rows, example_owners, example_repositories).where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e", "verdict"))).alias("taken"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    as_text = lambda a: F.array_join(F.transform(a, lambda c: F.concat(F.element_at(names, c["kind"] + 1), F.lit(":"), c["s"], F.lit(":"), c["e"])), ",")
    all_rows = rows.select("row", "doc_id").join(spans, "row", "left")
    taken = F.coalesce("taken", F.array().cast("array<struct<s:int,kind:int,e:int,verdict:string>>"))
    all_rows = all_rows.select("doc_id", taken.alias("taken"), "most_owners", "most_repositories").withColumn("base", F.filter("taken", lambda c: c["kind"] < len(BASE)))
    count = lambda test: F.expr(f"cast(size(filter(taken, c -> {test})) as bigint)")
    return all_rows.select(
        "doc_id",
        *[count(f"c.kind = {k}").alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("taken")).alias("spans"),
        count(f"c.kind >= {len(BASE)}").alias("n_added"),
        count("c.verdict = 'live'").alias("n_live"),
        count("c.verdict = 'example'").alias("n_example"),
        F.size("taken").cast("long").alias("n_spans"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
