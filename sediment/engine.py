"""One object over a store's tables: the engine's public methods as DataFrame programs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import text as T
from sediment.operators import beliefs, graph, history, recall, references, reports, retrieval, workspace
from sediment.plans import common
from sediment.runtime import materialize
from sediment.sources import table

TABLES = ("memories", "memory_vectors", "entity_triples", "associative_links", "notes", "context_blocks", "predicate_kinds", "personas")


class MemoryEngine:
    """Reads the tables of ``directory``; ``as_of`` is "now" for everything that depends on time. Nothing is
    changed in place: methods that would change a store return the rows to write."""

    def __init__(self, spark: SparkSession, directory: str, as_of: str = common.AS_OF):
        self.spark, self.directory, self.as_of = spark, directory, F.lit(as_of).cast("timestamp")

    # tables
    def memories(self) -> DataFrame:
        return common.memories(self.spark, self.directory)

    def facts(self) -> DataFrame:
        return common.facts(self.spark, self.directory)

    def links(self) -> DataFrame:
        return common.links(self.spark, self.directory)

    def notes(self) -> DataFrame:
        return table(self.spark, self.directory, "notes")

    def get_memory(self, memory_id: int) -> DataFrame:
        return self.memories().where(F.col("id") == memory_id)

    def vectors(self) -> DataFrame:
        return table(self.spark, self.directory, "memory_vectors")

    # retrieval
    def _lexical(self, queries: DataFrame, memories: DataFrame) -> DataFrame:
        text = F.concat_ws(" ", "content", "category", F.array_join("tags", " "))
        return retrieval.bm25(materialize(retrieval.postings(memories, "id", text)), queries)  # read three times

    def recall(self, queries: DataFrame, limit: int = 5, least: float = 0.2, scope: str | None = None, include_expired: bool = False) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, text), by words only."""
        m = self.memories()
        return retrieval.recall(retrieval.hybrid(retrieval.valid(m, self.as_of, scope, include_expired), self._lexical(queries, m), self.as_of), limit, least)

    def recall_full(self, queries: DataFrame, used: DataFrame | None = None, limit: int = 5, least: float = 0.2, scope: str | None = None, resonance: bool = True, walk: bool = True) -> DataFrame:
        """The same for queries (query_id, text, vector), by words, vectors and feedback (id, helped, misled), then over
        the graph around the results."""
        m = self.memories()
        none = self.spark.createDataFrame([], "id long, helped long, misled long")
        found = materialize(recall.hybrid_search(retrieval.valid(m, self.as_of, scope), self.vectors(), self._lexical(queries, m), queries.select("query_id", "vector"), used if used is not None else none, self.as_of, limit, least))
        if resonance:
            found = materialize(recall.resonant(found, self.links(), m, limit))
        return recall.ranked_by_graph(found, self.links(), self.facts(), m, limit) if walk else found

    def evidence(self, found: DataFrame) -> DataFrame:
        return recall.attached(found, self.facts())

    def contradictions(self, found: DataFrame) -> DataFrame:
        return beliefs.contradictions(found, self.facts())

    def render(self, found: DataFrame) -> DataFrame:
        return workspace.rendered(found, self.memories())

    def effects(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        return recall.side_effects(found)

    def drift(self, said: DataFrame) -> DataFrame:
        return recall.drifted(said, self.memories(), self.vectors())

    def expand(self, seeds: DataFrame) -> DataFrame:
        return graph.resonance(seeds, self.links())

    def page_rank(self, seeds: DataFrame) -> DataFrame:
        return graph.page_rank(seeds, self.links())

    def route(self, prompts: DataFrame, text: str = "text") -> DataFrame:
        return prompts.withColumn("intent", T.intent(F.col(text)))

    def scrub(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn(text, T.redact_secrets(F.col(text))[0])

    # write path
    def remember(self, said: DataFrame) -> DataFrame:
        return beliefs.remembered(said, self.memories())

    def extract_and_upsert(self, said: DataFrame) -> DataFrame:
        return beliefs.extracted_upserts(said, self.facts())

    def delete_facts(self, ids: DataFrame) -> DataFrame:
        return beliefs.deleted(ids, self.memories(), self.facts())

    def promote(self, ids: DataFrame, to: str = "global") -> DataFrame:
        """(id, scope) of the active ones among these memories."""
        return self.memories().where("is_active").join(ids, "id", "left_semi").select("id", F.lit(to).alias("scope"))

    def blocks(self) -> DataFrame:
        return workspace.blocks(table(self.spark, self.directory, "context_blocks")).orderBy("name")

    def set_blocks(self, updates: DataFrame, append: bool = False) -> DataFrame:
        return workspace.set_blocks(table(self.spark, self.directory, "context_blocks"), updates, append)

    def delete_block(self, name: str) -> DataFrame:
        return self.blocks().where(F.col("name") != name)

    def contest(self, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        return workspace.arbitrated(log, keys, order)

    # beliefs
    def extract(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("triples", T.triples(F.col(text)))

    def conflicts(self) -> DataFrame:
        return beliefs.conflicts(self.facts(), self.memories())

    def upserts(self) -> DataFrame:
        return beliefs.upsert_actions(self.facts())

    def sweep_expired(self) -> DataFrame:
        return beliefs.expired(self.memories(), self.as_of)

    def evict(self, cap: int = 1000) -> DataFrame:
        return beliefs.evicted(self.memories(), self.as_of, cap)

    def forget(self, target: str) -> DataFrame:
        return beliefs.forgotten(self.memories(), self.facts(), target)

    def delete_by_source(self, **source) -> DataFrame:
        return beliefs.by_source(self.memories(), **source)

    def purge(self, ids: DataFrame) -> DataFrame:
        return beliefs.receipts(self.memories().join(ids, "id", "left_semi"), self.as_of)

    def timeline(self) -> DataFrame:
        return beliefs.timeline(self.memories(), self.facts())

    def diff(self) -> DataFrame:
        return beliefs.differences(self.memories())

    def decay(self, days: int = 14) -> DataFrame:
        return beliefs.decayed(self.memories(), self.as_of, days)

    def history(self) -> DataFrame:
        return history.attribute_versions(table(self.spark, self.directory, "entity_triples"), table(self.spark, self.directory, "predicate_kinds"))

    # reports
    def doctor(self) -> DataFrame:
        m, f = self.memories(), self.facts()
        return reports.audit(f, m, beliefs.orphaned(f, m), self.as_of)

    def broken_references(self) -> DataFrame:
        t, a, m = (table(self.spark, self.directory, n) for n in ("entity_triples", "associative_links", "memories"))
        return references.broken_references(t, a, m)

    def card(self, limit: int = 15) -> DataFrame:
        return reports.standing_card(self.facts(), self.memories(), limit)

    def rules(self, scope: str | None = None) -> DataFrame:
        return reports.active_rules(self.memories(), scope)

    def digest(self, hours: int = 24) -> DataFrame:
        return reports.digest(self.timeline(), self.as_of - F.expr(f"interval {int(hours)} hours"))

    def prime(self, limit: int = 10) -> DataFrame:
        return reports.primer(self.memories(), limit)

    def sessions(self) -> DataFrame:
        return reports.sessions(self.memories(), self.notes())

    def rollup(self, most: int = 50) -> DataFrame:
        return reports.rollup(self.memories(), most)

    def communities(self) -> DataFrame:
        return graph.communities(self.facts(), self.memories())

    def rule_lines(self, scope: str | None = None) -> DataFrame:
        return workspace.rule_lines(self.memories(), scope)

    def session_counters(self) -> DataFrame:
        return workspace.session_counters(self.memories(), self.notes())

    def recent_sessions(self, limit: int = 10) -> DataFrame:
        return workspace.recent_sessions(self.notes(), limit)

    def community_list(self) -> DataFrame:
        return graph.described(self.communities(), self.facts(), self.memories())

    def table_counts(self) -> DataFrame:
        names = ("memories", "memory_vectors", "entity_triples", "associative_links", "notes")
        parts = [table(self.spark, self.directory, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names]
        return reduce(DataFrame.unionByName, parts)

    # packs
    def export_pack(self, path: str) -> None:
        """The pack under ``path``/rows and its checksums under ``path``/checksums."""
        reports.pack_rows(self.memories(), self.facts()).write.mode("overwrite").json(f"{path}/rows")
        reports.pack_checksum(self.read_pack(path)).write.mode("overwrite").json(f"{path}/checksums")

    def read_pack(self, path: str) -> DataFrame:
        return self.spark.read.schema("kind string, id long, parent long, line string").json(f"{path}/rows")

    def import_pack(self, path: str) -> tuple[DataFrame, DataFrame]:
        """The memories and triples that an import would write; raises ValueError if the checksums differ."""
        sums = self.spark.read.schema("kind string, n long, checksum string").json(f"{path}/checksums")
        return reports.imported_pack(reports.verified_pack(self.read_pack(path), sums), self.memories())

    def export_vault(self, path: str) -> None:
        """One row per markdown file, partitioned by folder."""
        reports.vault_files(self.memories()).write.mode("overwrite").partitionBy("folder").parquet(path)

    def backup(self, path: str) -> None:
        for name in TABLES:
            table(self.spark, self.directory, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")

    def restored(self, path: str) -> MemoryEngine:
        """The engine over a backup."""
        return MemoryEngine(self.spark, path)
