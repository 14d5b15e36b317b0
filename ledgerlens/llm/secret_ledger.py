"""Incremental secret scan: a ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for each blob, the rule versions that
have scanned it and what they found. A run computes the digests of all texts, scans only blobs that some current
rule version hasn't seen, with just those rules, appends the outcome to the ledger, and joins findings back to all
paths. Rules are built-in regular expressions, and a blob with thousands of paths is scanned once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import discard, empty, fresh_path, materialise
from .text import spans, whole


def either_case(word: str) -> str:
    """A pattern for an ASCII word in any mix of cases, without regard to locale or Unicode folding."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; one stays if ``group`` of ``part`` has at least ``least`` characters in it."""

    name: str
    pattern: str
    part: str = "^.*$"
    least: int = 0
    group: int = 0

    @property
    def version(self) -> str:
        what = (self.pattern, self.part, self.least, *([self.group] if self.group else []))
        return f"{self.name}@{hashlib.sha256(repr(what).encode()).hexdigest()[:12]}"

    def found(self, text: Column) -> Column:
        hits = spans(text, self.pattern)
        if self.least:
            hits = F.filter(hits, lambda x: F.length(F.regexp_extract(x.m, self.part, self.group)) >= self.least)
        return F.transform(hits, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.lit(self.name).alias("rule")))


KEYWORDS = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
VALUE = "[A-Za-z0-9+/_.=-]+"
BEFORE = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?"""
ASSIGN = BEFORE + VALUE

#: The base kinds in their order, then those that this operator adds.
RULES = [
    Rule("assign", ASSIGN, f"^{BEFORE}({VALUE})$", 6, 1),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
]
BASE = 3
#: The rules as they were before: one added kind less, and another pattern for the other.
FORMER_RULES = [*RULES[:BASE], Rule("pem", "-----BEGIN [A-Z]+ PRIVATE KEY-----")]

_LEDGER = "digest string, versions array<string>, found array<struct<s:bigint,e:bigint,rule:string>>"
_FOUND = "array<struct<s:bigint,e:bigint,rule:string>>"


class BlobLedger:
    """A Parquet table ``(digest, versions, found)`` in a folder that all executors reach; runs only append."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        if self.exists():
            return self.spark.read.schema(_LEDGER).parquet(self.path)
        return empty(self.spark, _LEDGER)

    def unseen(self, docs: DataFrame, rules: list[Rule], path: Column) -> DataFrame:
        """``(digest, path, todo)``: one path for each blob that some rule version hasn't scanned, and those versions as bits."""
        known = sum((F.when(F.array_contains("versions", r.version), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0).cast("long"))
        seen = self.read().groupBy("digest").agg(F.bit_or(known).alias("seen"))
        blobs = docs.groupBy("digest").agg(F.min(path).alias("path"))
        todo = F.lit((1 << len(rules)) - 1).cast("long").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        return blobs.join(seen, "digest", "left").select("digest", "path", todo.alias("todo")).where("todo <> 0")

    def scan(self, docs: DataFrame, rules: list[Rule] = RULES) -> None:
        """Scan what is new among ``docs(doc_id, text)`` and commit it as one append.

        Which blobs are due for which rule versions is found without their texts. A version that the ledger has nowhere is due
        for every blob, so its pattern is tried where the texts are read, and only texts in which it stands somewhere move to
        be scanned, one for each blob. For versions that know some blobs the texts of the others move as they are.
        """
        keyed = docs.select(F.col("doc_id").alias("path"), whole("text").alias("text"))
        slim = keyed.select("path", F.sha2("text", 256).alias("digest"))
        todo = materialise(self.unseen(slim, rules, F.col("path")), "todo")
        known = {r.v for r in self.read().select(F.explode("versions").alias("v")).distinct().collect()}  # as many as there ever were
        groups = [[(i, r) for i, r in enumerate(rules) if (r.version in known) == old] for old in (False, True)]
        bits = [sum(1 << i for i, _ in g) for g in groups]
        none = F.expr(f"cast(array() AS {_FOUND})")
        due = lambda i: F.col("todo").bitwiseAND(1 << i) != 0

        def hits(texts: DataFrame, group: list[tuple[int, Rule]], mask: int) -> DataFrame:
            want = todo.where(F.col("todo").bitwiseAND(mask) != 0).select(F.unhex("digest").alias("_blob"), F.col("path").alias("_path"), "todo")
            here = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
            rows = here.join(want, (F.col("digest") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
            found = F.concat(*[F.when(due(i), r.found(F.col("text"))).otherwise(none) for i, r in group])
            # rows repeated in full come twice
            return rows.select(F.lower(F.hex("digest")).alias("digest"), found.alias("found")).where(F.size("found") > 0).dropDuplicates(["digest"])

        parts = []
        if groups[0]:
            stands = F.lit(False)
            for _, r in groups[0]:
                stands = stands | F.col("text").rlike(r.pattern)
            parts.append(hits(keyed.where(stands), groups[0], bits[0]))
        if groups[1] and not todo.where(F.col("todo").bitwiseAND(bits[1]) != 0).isEmpty():
            parts.append(hits(keyed, groups[1], bits[1]))
        versions = F.array_compact(F.array(*[F.when(due(i), F.lit(r.version)) for i, r in enumerate(rules)]))
        rows, found = todo.select("digest", versions.alias("versions")), none
        for n, part in enumerate(parts):
            rows = rows.join(part.withColumnRenamed("found", f"found{n}"), "digest", "left")
            found = F.concat(found, F.coalesce(f"found{n}", none))
        rows.select("digest", "versions", found.alias("found")).write.mode("append").parquet(self.path)
        discard(todo)

    def findings(self, rules: list[Rule] = RULES) -> DataFrame:
        """``(digest, found)`` of the current rule versions, a row for each blob with any; repeats are dropped."""
        current = F.array(*[F.lit(r.version) for r in rules])
        rows = self.read().where(F.size("found") > 0)
        name = lambda v: F.substring_index(v, "@", 1)
        own = F.transform(F.array_intersect("versions", current), name)
        kept = F.filter("found", lambda x: F.array_contains(own, x.rule))
        order = F.map_from_arrays(F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(i) for i in range(len(rules))]))
        each = rows.select("digest", F.explode(kept).alias("x")).select("digest", "x.s", F.element_at(order, F.col("x.rule")).alias("k"), "x.e", "x.rule").distinct()
        return each.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "rule"))).alias("found"))


def secret_findings(docs: DataFrame, ledger: BlobLedger, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, digest, found`` for every row of ``docs(doc_id, text)``; ``found`` is sorted by start, then rule.

    Scans through ``ledger``, so texts that it knows aren't read by any rule again. Null texts count as empty; rows
    without doc_id and repeated rows get their findings like all others; other columns aren't looked at. A very long
    text, or one with very many matches, takes time in proportion to its length and to n log n of its matches.
    """
    ledger.scan(docs, rules)
    paths = docs.select("doc_id", F.sha2(whole("text"), 256).alias("digest"))
    found = F.coalesce("found", F.expr("cast(array() AS array<struct<s:bigint,k:int,e:bigint,rule:string>>)"))
    return paths.join(ledger.findings(rules), "digest", "left").select("doc_id", "digest", found.alias("found"))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of the found spans, as the registered query returns them."""
    text = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x.rule, x.s.cast("string"), x.e.cast("string"))))
    of = lambda i: F.size(F.filter("found", lambda x: x.k == i)).cast("long")
    return found.select(
        "doc_id", *[of(i).alias(f"n_{RULES[i].name}") for i in range(BASE)],
        F.sha2(text(F.filter("found", lambda x: x.k < BASE)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )


