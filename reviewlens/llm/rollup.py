"""Token totals by source, language and tokenizer version, kept up to date from changes.

A batch of changes (insert, delete, revise) becomes signed rows: what a document counted before is taken
off, what it counts now is added. Signed rows sum to one delta per source, language and version, deltas
sum to totals, so a batch costs its own rows and what the ledger holds for the same documents.

Storage is a folder in the shared store: ``ledger`` holds what each changed document counts since a commit,
``delta`` the sums, both written under a name of this very attempt. A commit is a small file that names
them; its number is the next one, and it is created only if there is none of that number. So commits have
one order, which is that of the changes whatever the batch ids are: a batch whose id is smaller than that of
one before it is simply a later change. A batch id that is committed already is skipped. Of two jobs that
commit at once one gets the number; the other finds its sums out of date, reads what the first one changed,
and takes the next number, or stops if it was the same batch. Readers follow commits only, so a job that died
half way changes nothing. ``compact`` folds all commits into one, so that readers open few files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.published import list_names, read_file, write_once

KEYS = ["source", "lang", "version"]
LEDGER = ("doc_id bigint, version string, entries array<struct<source: string, lang: string, documents: bigint, tokens: bigint>>, "
          "number bigint")
DELTA = "source string, lang string, version string, documents bigint, tokens bigint"


def white_space_tokens(text: Column) -> Column:
    """Runs outside white space (0x20, 0x09-0x0D)."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_and_mark_tokens(text: Column) -> Column:
    """Runs of letters, single digits, and every other visible character by itself."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]")).cast("long")


VERSIONS = {"space-1": white_space_tokens, "mark-2": word_and_mark_tokens}


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.known: dict[str, dict] = {}  # commits never change, so each is read once

    def commits(self) -> list[dict]:
        """All commits in their order: number, batch (null for a compaction), ledger and delta."""
        for name in list_names(self.spark, f"{self.folder}/commits"):
            if name.endswith(".json") and name not in self.known:
                self.known[name] = json.loads(read_file(self.spark, f"{self.folder}/commits/{name}"))
        return [self.known[name] for name in sorted(self.known)]

    def _read(self, part: str, schema: str, commits: list[dict]) -> DataFrame:
        last = max((n for n, c in enumerate(commits) if c["batch"] is None), default=0)
        paths = [f"{self.folder}/{part}/{c[part]}" for c in commits[last:]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _entries(self, commits: list[dict], of: DataFrame | None = None) -> DataFrame:
        """doc_id, version, entries, number of the last commit of each document; ``of`` names the documents asked for.

        Files are sorted by doc_id, so the range of those asked for leaves most of a large ledger unread.
        """
        rows = self._read("ledger", LEDGER, commits)
        if of is not None:
            ends = of.agg(F.min("doc_id"), F.max("doc_id")).first()
            rows = rows.where(F.col("doc_id").between(*ends)).join(of.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        return rows.groupBy("doc_id", "version").agg(F.max_by("entries", "number").alias("entries"), F.max("number").alias("number"))

    def ledger(self) -> DataFrame:
        """What each document counts now: doc_id, version, source, lang, documents, tokens; deleted ones have no row."""
        return self._entries(self.commits()).select("doc_id", "version", F.inline("entries"))

    def _commit(self, number: int, **content: object) -> bool:
        return write_once(self.spark, f"{self.folder}/commits/{number:010d}.json", json.dumps({"number": number, **content}))

    def commit(self, batch: int, changes: DataFrame, add_unnamed: bool = False) -> bool:
        """Apply changes (doc_id, version, source, lang, tokens; tokens null deletes); False if it was done before.

        What a batch says of a document and version replaces what they counted so far. Rows of a batch that share
        both are counted each, under their own source and language; next to them a deletion has no effect.
        Rows with a null version are left out, and so are those with a null doc_id unless ``add_unnamed``:
        then they count too, though no later change can name them. A null source or lang is a value of its
        own. Deleting what isn't there, or giving the same count again, changes nothing.
        """
        if any(c["batch"] == batch for c in self.commits()):
            return False
        attempt = uuid.uuid4().hex
        named = changes.where("version IS NOT NULL").select(
            F.col("doc_id").cast("long").alias("doc_id"), "version", "source", "lang", F.col("tokens").cast("long").alias("tokens"))
        sums = named.groupBy("doc_id", *KEYS).agg(F.count("tokens").alias("documents"), F.sum("tokens").alias("tokens"))
        counted = F.struct("source", "lang", "documents", "tokens")
        # The group is the sources and languages that a batch gives one document.
        entries = sums.groupBy("doc_id", "version").agg(
            F.collect_list(F.when(F.col("documents") > 0, counted)).alias("entries"), F.lit(0).cast("long").alias("number"))
        drafts = f"{self.folder}/drafts/{attempt}"
        entries.write.parquet(drafts)
        drafted = self.spark.read.schema(LEDGER).parquet(drafts)
        new = drafted.where("doc_id IS NOT NULL")
        added = drafted if add_unnamed else new
        while True:
            commits = self.commits()
            if any(c["batch"] == batch for c in commits):
                return False
            number = commits[-1]["number"] + 1 if commits else 0
            name = f"{number}-{attempt}"
            new.withColumn("number", F.lit(number).cast("long")).repartitionByRange("doc_id").sortWithinPartitions(
                "doc_id").write.parquet(f"{self.folder}/ledger/{name}")
            signed = added.select("version", F.inline("entries"), F.lit(1).alias("sign"))
            if commits:
                old = self._entries(commits, new).select("version", F.inline("entries"), F.lit(-1).alias("sign"))
                signed = signed.unionByName(old)
            delta = signed.groupBy(*KEYS).agg(
                F.sum(F.col("sign") * F.col("documents")).alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
            delta.write.parquet(f"{self.folder}/delta/{name}")
            if self._commit(number, batch=batch, ledger=name, delta=name):
                return True

    def compact(self) -> bool:
        """Fold what is committed into one commit; False if another commit came first, or there is nothing to fold."""
        commits = self.commits()
        if not commits:
            return False
        number = commits[-1]["number"] + 1
        name = f"{number}-{uuid.uuid4().hex}"
        kept = self._entries(commits).where(F.size("entries") > 0)
        kept.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.folder}/ledger/{name}")
        self.totals().select(*[c.split()[0] for c in DELTA.split(", ")]).write.parquet(f"{self.folder}/delta/{name}")
        return self._commit(number, batch=None, ledger=name, delta=name)

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens: sums of the committed deltas; keys without documents are left out."""
        sums = self._read("delta", DELTA, self.commits()).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0")


def count_changes(docs: DataFrame, versions: dict = VERSIONS, delete: Column | None = None) -> DataFrame:
    """One change per document and tokenizer version; null texts count 0, rows for which ``delete`` holds go."""
    counts = F.explode(F.array(*(
        F.struct(F.lit(name).alias("version"), count(F.coalesce("text", F.lit(""))).alias("tokens"))
        for name, count in versions.items())))
    gone = F.lit(False) if delete is None else F.coalesce(delete, F.lit(False))
    rows = docs.select("doc_id", "source", "lang", gone.alias("gone"), counts.alias("c"))
    return rows.select("doc_id", "c.version", "source", "lang", F.when(~F.col("gone"), F.col("c.tokens")).alias("tokens"))
