"""The driver's tables bound to the evidence model.

Orders are postings, their lines enrichment versions; brands play technologies and part types
capabilities. Every operator takes its columns and thresholds as parameters, so the same code
runs over real postings.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from signalloom.operators import analytics, crossdomain, evidence as ev, graph, technology as tech
from signalloom.operators.ordering import latest_enrichment
from signalloom.session import stage
from signalloom.sources.snapshots import parquet

NAMES = {"brand#1": "AWS", "brand#2": "AWS", "brand#3": "Oracle"}
CATEGORIES = {"AWS": "Cloud Platform", "Oracle": "Database", **{f"Brand#{i}": "Data Platform" for i in range(5, 13)}}
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
# Every third brand has no form, so its keyword observations have no excerpt.
KEYWORDS = {f"Brand#{i}": ["role at"] if i % 3 == 0 else [SEGMENTS[i % 5]] for i in range(1, 26) if i % 3 < 2}
EXCERPT_WINDOW = 10
HIRING = analytics.HiringThresholds(geographic_minimum_percentage=18.0, capability_minimum_percentage=30.0, trend_minimum_directional_change=0.02)
TECHNOLOGY = tech.TechnologyThresholds(technology_minimum_concentration=0.2, category_minimum_concentration=0.3, context_minimum_concentration=0.02)
CROSS = crossdomain.CrossThresholds(minimum_domain_concentration=0.18)
UNITS = crossdomain.CrossThresholds(minimum_domain_concentration=0.004)


def _pick(column, n: int, values: list) -> F.Column:
    out = None
    for i, value in enumerate(values[:-1]):
        out = F.when(column % n == i, value) if out is None else out.when(column % n == i, value)
    return out.otherwise(values[-1])


_STAGED: dict[tuple[str, ...], "Staged"] = {}


@dataclass(frozen=True)
class Need:
    """What the queries of one kind read of the job table: job columns beside the ``base`` (those of the hiring facets), evidence and enrichment fields."""

    jobs: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ("source_type",)
    enrichment: tuple[str, ...] = ()
    observed: bool = False
    graph: bool = False  # whether the columns that graph steps name and the kind does not need are there as nulls
    base: tuple[str, ...] = ("organization", "job_id", "evidence_id", "location", "country", "seniority_level", "is_leadership", "posted_date", "capability_classifications")


HIRED = Need().base
KEYS = ("organization", "job_id", "evidence_id")
LISTS = ("capability_classifications", "technologies")
NEEDS = {
    "hiring": Need(("source_job_id", "title"), ("source_type", "source_url")),
    "technology": Need(("business_unit", "technologies"), enrichment=("evidence_id", "technologies", "business_unit", "seniority_level"), observed=True),
    "graph": Need(
        ("source_job_id", "title", "technologies"), ("source_type", "source_url"),
        ("evidence_id", "provider", "model", "prompt_schema_version", "confidence", "source_content_hash", "business_unit", "capability_classifications", "technologies", "seniority_level"),
    ),
    "edges": Need(("technologies",), enrichment=("business_unit", "capability_classifications", "technologies", "seniority_level"), graph=True),
    "capabilities": Need(("posted_date", "capability_classifications"), enrichment=("capability_classifications",), graph=True, base=KEYS),
    "provenance": Need(("source_job_id", "posted_date", "capability_classifications"), enrichment=("provider", "capability_classifications"), graph=True, base=KEYS),
    "technologies": Need(("posted_date", "technologies"), enrichment=("technologies",), graph=True, base=KEYS),
    "insights": Need(("posted_date", *LISTS), enrichment=LISTS, graph=True, base=KEYS),
    "coverage": Need(("capability_classifications",), enrichment=("capability_classifications",), graph=True, base=KEYS),
    "checks": Need(enrichment=("evidence_id",), graph=True, base=KEYS),
    "observed": Need(
        ("location", "business_unit", "posted_date", "technologies"), enrichment=("evidence_id", "technologies", "business_unit", "seniority_level"), observed=True, base=KEYS,
    ),
    "summary": Need(("business_unit", "technologies"), ("source_type", "retrieved_at"), ("evidence_id", "technologies", "business_unit", "seniority_level"), True),
}


def _with_graph_columns(rows: DataFrame) -> DataFrame:
    """Staged rows with every column that graph steps name; those the kind does not read are null."""
    kind = lambda field: "array<string>" if field in LISTS else "double" if field == "confidence" else "date" if field == "posted_date" else "string"

    def struct(name, fields):
        known = rows.schema[name].dataType.names
        made = [F.col(name)[f].alias(f) if f in known else F.lit(None).cast(kind(f)).alias(f) for f in fields]
        return F.when(F.col(name).isNotNull(), F.struct(*made))

    jobs = {c: F.lit(None).cast(kind(c)) for c in ("source_job_id", "title", "location", "posted_date", *LISTS) if c not in rows.columns}
    return rows.withColumns(jobs | {"evidence": struct("evidence", ("source_type", "source_url")), "enrichment": struct("enrichment", ("evidence_id", *graph.ENRICHED_FIELDS))})


@dataclass
class Binding:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return parquet(self.spark, self.folder, name)

    @cached_property
    def postings(self) -> DataFrame:
        """Jobs without their list columns."""
        return self._jobs(None)

    @cached_property
    def jobs(self) -> DataFrame:
        """Jobs with capabilities and technologies."""
        return self._jobs(self._lists())

    def _lists(self) -> DataFrame:
        """Distinct part types and brands per order; both are few, so task-side sets stay small."""
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return lines.withColumn("job_id", F.col("l_orderkey").cast("string")).groupBy("job_id").agg(
            F.array_sort(F.collect_set("p_type")).alias("capability_classifications"), F.array_sort(F.collect_set("p_brand")).alias("technologies")
        )

    def _jobs(self, lists: DataFrame | None) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        key, name, segment, region = F.col("o_orderkey"), F.col("n_name"), F.col("c_mktsegment"), F.col("r_name")
        text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
        location = _pick(key, 4, [text(name, ", ", segment), name, text(name, ", ", segment, ", ", region), text(name, ", ", segment, " / ", "Remote, ", region)])
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        orders = orders.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("job_id", key.cast("string"))  # 25 nations
        listed = []
        if lists is not None:
            # By the key that enrichments are joined by later, so the jobs keep their places.
            orders = orders.join(lists, "job_id", "left")
            none = F.array().cast("array<string>")
            listed = [F.coalesce(c, none).alias(c) for c in ("capability_classifications", "technologies")]
        return orders.select(
            region.alias("organization"),
            "job_id", key.cast("string").alias("source_job_id"),
            F.col("c_name").alias("title"), text(segment, " role at ", F.col("c_name"), ", ", name).alias("description"),
            F.when(key % 97 == 0, F.lit("")).otherwise(location).alias("location"),
            _pick(F.floor(F.col("n_nationkey") / 5), 5, ["US", "CA", "IN", "GB", "AU"]).alias("country"),
            F.when(key % 3 != 0, segment).alias("business_unit"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.expr("substring(o_orderpriority, 3)")).alias("seniority_level"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_leadership"),
            F.to_date("o_orderdate").alias("posted_date"),
            F.col("o_orderstatus").alias("employment_type"),
            text("https://jobs.example.com/", key.cast("string")).alias("source_url"),
            text("E", key.cast("string")).alias("evidence_id"),
            *listed,
        )

    @cached_property
    def evidence(self) -> DataFrame:
        key = F.col("o_orderkey")
        rows = self.table("orders").filter(key % 50 != 0).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            F.concat(F.lit("E"), key.cast("string")).alias("evidence_id"),
            F.concat(F.lit("https://jobs.example.com/"), key.cast("string")).alias("source_url"),
            _pick(key, 2, ["career_site", "job_board"]).alias("source_type"),
            F.col("c_name").alias("source_title"),
            F.col("o_orderdate").alias("retrieved_at"),
            F.concat(F.col("c_mktsegment"), F.lit(" role  at "), F.col("c_name")).alias("source_excerpt"),
            F.concat(F.lit("ref:"), key.cast("string")).alias("raw_reference"),
            F.col("c_mktsegment").alias("collector_identity"),
            F.when(key % 5 == 0, F.lit('{"source_system":"Workday"}')).otherwise(F.lit("{}")).alias("provenance_metadata"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their part and supplier.

        Suppliers meet the lines by themselves: the product of their size and the nations', as which Spark sizes a join,
        would let all lines be shuffled by supplier.
        """
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        supplied = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        return supplied.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("job_id", F.col("l_orderkey").cast("string"))

    @cached_property
    def enrichments(self) -> DataFrame:
        return self._enriched(self.lines)

    def _enriched(self, rows: DataFrame) -> DataFrame:
        line = F.col("l_linenumber")
        pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
        evidence_id = F.concat(F.when(line == 3, F.lit("X")).otherwise(F.lit("E")), F.col("l_orderkey").cast("string"))
        return rows.select(
            "job_id",
            evidence_id.alias("evidence_id"),
            F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"),
            F.concat(F.lit("v"), line.cast("string"), F.lit("."), pad("l_partkey"), F.lit("."), pad("l_suppkey")).alias("prompt_schema_version"),
            F.col("l_shipdate").alias("enrichment_timestamp"),
            F.array_distinct(F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")))).alias("technologies"),
            F.array("p_type").alias("capability_classifications"),
            F.split("p_name", " ").alias("skills"),
            F.when(F.col("l_suppkey") % 7 != 0, F.col("n_name")).alias("business_unit"),
            _pick(line, 3, ["senior", "director", "unknown"]).alias("seniority_level"),
            (F.col("l_discount") + 0.5).alias("confidence"),
            F.when(F.col("l_tax") > 0.04, F.create_map(F.lit("technologies"), F.lit(0.9))).otherwise(F.create_map().cast("map<string,double>")).alias("field_confidences"),
            F.array(F.struct(F.lit("technologies").alias("field"), F.col("p_brand").alias("value"), F.col("p_name").alias("excerpt"), evidence_id.alias("evidence_id"))).alias("field_support"),
            F.sha2(F.col("p_name"), 256).alias("source_content_hash"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Collection runs: one per supplier and year of its first line."""
        rows = self.table("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(
            F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("completed_at"), F.count(F.lit(1)).alias("records_encountered"),
            F.count_if(F.col("l_returnflag") == "R").alias("records_skipped"), F.count_distinct("l_orderkey").alias("pages_attempted"),
        )
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        supplier = self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        return rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.format_string("run-%09d-%d", "l_suppkey", "y").alias("run_id"), F.col("r_name").alias("organization"), "started_at", "completed_at", "pages_attempted", "records_encountered",
            (F.col("records_encountered") - F.col("records_skipped")).alias("records_collected"), "records_skipped",
            F.when(F.col("records_skipped") == 0, F.lit("completed")).otherwise(F.lit("partial")).alias("status"),
        )

    @cached_property
    def latest(self) -> DataFrame:
        """Only a job's newest lines are made wide; both choices are made where the lines of a job have met."""
        newest = self.lines.withColumn("_newest", F.max("l_shipdate").over(Window.partitionBy("job_id"))).filter(F.col("l_shipdate").eqNullSafe(F.col("_newest")))
        return latest_enrichment(self._enriched(newest))

    @cached_property
    def rows(self) -> DataFrame:
        return tech.enriched_jobs(self.jobs, self.evidence, self.latest)

    @cached_property
    def observations(self) -> DataFrame:
        return tech.observations(self.rows, NAMES, CATEGORIES, KEYWORDS, {}, window=EXCERPT_WINDOW)

    @cached_property
    def observed_names(self) -> DataFrame:
        """Job, evidence and technology of every observation."""
        return tech.observed_names(self.rows, NAMES)

    @cached_property
    def tech_facets(self) -> DataFrame:
        return tech.tech_facets(self.rows, NAMES, CATEGORIES)

    @cached_property
    def tech_counts(self) -> DataFrame:
        return tech.tech_counts(self.tech_facets)

    @cached_property
    def tech_snapshot(self) -> DataFrame:
        return tech.tech_snapshot(self.postings, self.tech_counts)

    @cached_property
    def hiring_counts(self) -> DataFrame:
        return analytics.facet_counts(analytics.job_facets(self.jobs, analytics.SIGNAL_FAMILIES))

    @cached_property
    def hiring_signals(self) -> DataFrame:
        return analytics.signals_from_counts(self.hiring_counts, HIRING)

    @cached_property
    def hiring_support(self) -> DataFrame:
        return analytics.hiring_signal_support(self.jobs, self.hiring_signals)

    @cached_property
    def technology_signals(self) -> DataFrame:
        """The counts, few, are written first: the snapshot reads them too."""
        counts = stage(self.tech_counts, "technology-counts")
        return tech.technology_signals(tech.tech_snapshot(self.postings, counts), counts, TECHNOLOGY)

    @cached_property
    def technology_support(self) -> DataFrame:
        return tech.technology_signal_support(self.tech_facets, self.technology_signals)

    @cached_property
    def links(self) -> DataFrame:
        return ev.evidence_links(self.hiring_support, self.technology_support, self.observed_names)

    @cached_property
    def records(self) -> DataFrame:
        """Unified evidence without signal counts."""
        return ev.unified_evidence(self.jobs, self.evidence, self.latest)

    @cached_property
    def unified(self) -> DataFrame:
        return ev.unified_rows(self.rows, self.links) if isinstance(self, Staged) else ev.unified_evidence(self.jobs, self.evidence, self.latest, self.links)

    @cached_property
    def gate(self) -> DataFrame:
        """The global gate alone, without counting signals."""
        snapshot = self.tech_snapshot.select("organization", "total_jobs", "enriched_jobs", "technology_observation_count", "observation_start", "observation_end")
        return crossdomain.gated(snapshot.withColumn("enrichment_coverage", F.col("enriched_jobs") / F.col("total_jobs")), CROSS)

    @cached_property
    def context(self) -> DataFrame:
        return crossdomain.coverage_context(self.tech_snapshot, self.rows, self.hiring_signals, self.technology_signals, CROSS)

    @cached_property
    def tagged(self) -> DataFrame:
        return crossdomain.tagged_jobs(self.rows, NAMES, CATEGORIES)

    @cached_property
    def overlaps(self) -> DataFrame:
        """Counted pairs of all five families, from one pass over the jobs."""
        gates = crossdomain.hiring_gates(self.hiring_counts, self.gate, CROSS).unionByName(crossdomain.technology_gates(self.tech_counts, self.gate, CROSS))
        gates = gates.unionByName(crossdomain.unit_gates(self.tagged, self.gate, CROSS)).unionByName(crossdomain.signal_gates(self.hiring_signals, self.technology_signals, self.gate, CROSS))
        return crossdomain.overlaps(crossdomain.overlap_counts(self.tagged, gates), self.gate, CROSS)

    @cached_property
    def unit_overlaps(self) -> DataFrame:
        """Business units alone, under thresholds that the many small units of these tables reach."""
        gates = crossdomain.unit_gates(self.tagged, self.gate, UNITS)
        return crossdomain.overlaps(crossdomain.overlap_counts(self.tagged, gates), self.gate, UNITS)

    @cached_property
    def alignments(self) -> DataFrame:
        return crossdomain.alignments(self.overlaps, self.gate, CROSS)

    @cached_property
    def alignment_support(self) -> DataFrame:
        return crossdomain.alignment_support(self.tagged, self.alignments)

    @cached_property
    def staged(self) -> "Staged":
        """The intermediate tables of this application and folder, written once."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _STAGED:
            _STAGED[key] = Staged(self.spark, self.folder)
        return _STAGED[key]

    def lean(self, kind: str) -> "Staged":
        """The staged model with only what queries of a kind read, unless the whole one is written already."""
        whole = self.staged
        if "intelligence" in whole.__dict__:
            return whole
        key = (self.spark.sparkContext.applicationId, self.folder, kind)
        if key not in _STAGED:
            _STAGED[key] = Staged(self.spark, self.folder)
            _STAGED[key].need = NEEDS[kind]
        return _STAGED[key]


class Staged(Binding):
    """The same model over written intermediate tables, for queries that read it more than once.

    The joins run once into one job-level table; facet counts and signals, small per organization,
    are written too, so no later plan repeats them.
    """

    need: Need | None = None

    @cached_property
    def intelligence(self) -> DataFrame:
        need = self.need
        if need is None:
            return stage(tech.observed(ev.intelligence_rows(Binding._jobs(self, self._lists()), self.evidence, self.latest), NAMES), "intelligence")
        latest = self.latest.select("job_id", *need.enrichment) if need.enrichment else None
        rows = ev.intelligence_rows(self.jobs_of_need(), self.evidence, latest, need.evidence)
        written = stage(tech.observed(rows, NAMES) if need.observed else rows, "intelligence")
        return _with_graph_columns(written) if need.graph else written

    def jobs_of_need(self) -> DataFrame:
        """The job columns of the kind; order lines are read only for those that list them."""
        columns = (*self.need.base, *self.need.jobs)
        return Binding._jobs(self, self._lists() if {*columns} & {*LISTS} else None).select(*columns)

    @cached_property
    def sole(self) -> "Share":
        return Share(self, True)

    @cached_property
    def shared(self) -> "Share":
        return Share(self, False)

    @cached_property
    def links(self) -> DataFrame:
        return self.sole.own_links.unionByName(self.shared.own_links)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.intelligence.drop("evidence", "enrichment", "observations", "is_enriched", "source_type")

    @cached_property
    def postings(self) -> DataFrame:
        return self.jobs.drop("capability_classifications", "technologies")

    @cached_property
    def rows(self) -> DataFrame:
        return self.intelligence.filter("evidence IS NOT NULL")

    @cached_property
    def records(self) -> DataFrame:
        return ev.unified_rows(self.rows)

    @cached_property
    def hiring_counts(self) -> DataFrame:
        return stage(Binding.hiring_counts.func(self), "hiring-counts")

    @cached_property
    def tech_counts(self) -> DataFrame:
        return stage(Binding.tech_counts.func(self), "technology-counts")

    @cached_property
    def tech_snapshot(self) -> DataFrame:
        return stage(Binding.tech_snapshot.func(self), "technology-snapshot")

    @cached_property
    def hiring_signals(self) -> DataFrame:
        return stage(Binding.hiring_signals.func(self), "hiring-signals")

    @cached_property
    def technology_signals(self) -> DataFrame:
        return stage(tech.technology_signals(self.tech_snapshot, self.tech_counts, TECHNOLOGY), "technology-signals")

    @cached_property
    def overlaps(self) -> DataFrame:
        return stage(Binding.overlaps.func(self), "overlaps")


class Share(Staged):
    """The sole rows of a staged model, or those that share a job or evidence with others, under the signals of all.

    No evidence and no job is in both, so results per evidence or job are their union.
    """

    def __init__(self, whole: Staged, sole: bool):
        super().__init__(whole.spark, whole.folder)
        self.whole, self.is_sole = whole, sole

    @cached_property
    def intelligence(self) -> DataFrame:
        return self.whole.intelligence.filter(F.col("sole") == self.is_sole)

    @cached_property
    def hiring_signals(self) -> DataFrame:
        return self.whole.hiring_signals

    @cached_property
    def technology_signals(self) -> DataFrame:
        return self.whole.technology_signals

    @cached_property
    def own_links(self) -> DataFrame:
        return ev.evidence_links(self.hiring_support, self.technology_support, self.observed_names, self.is_sole)

    @cached_property
    def references(self) -> DataFrame:
        return ev.signal_references({"hiring": self.hiring_support, "technology": self.technology_support}, self.is_sole)
