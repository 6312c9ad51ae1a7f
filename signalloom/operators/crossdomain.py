"""Overlaps of hiring groups and technologies within the same jobs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.functions import lexicons as L
from signalloom.functions.ids import uuid5
from signalloom.functions.numbers import days_between, pct, ratio, unit
from signalloom.functions.text import bound, chained
from signalloom.operators.analytics import SUPPORT_FAMILIES, facet_array
from signalloom.operators.technology import observed, tech_facet_array, with_tech_totals
from signalloom.session import stage


@dataclass(frozen=True)
class CrossThresholds:
    minimum_total_jobs: int = 10
    minimum_enriched_jobs: int = 5
    minimum_enrichment_coverage: float = 0.25
    minimum_hiring_contributors: int = 3
    minimum_technology_contributors: int = 3
    minimum_unique_cross_domain_contributors: int = 3
    minimum_domain_concentration: float = 0.3
    minimum_observation_days: int = 14
    single_source_data: bool = True
    configuration_version: str = "cross-domain-signals-v1"


FAMILIES = ("capability", "city", "leadership", "business_unit", "cluster")
TYPES = {
    "capability": "capability_technology_alignment",
    "city": "geographic_technology_alignment",
    "business_unit": "business_unit_technology_alignment",
    "leadership": "leadership_technology_alignment",
    "cluster": "hiring_technology_cluster",
}


def coverage_context(tech_snapshot: DataFrame, unified: DataFrame, hiring_signals: DataFrame, technology_signals: DataFrame, t: CrossThresholds | None = None) -> DataFrame:
    """Coverage figures, the global gate and limitations per organization."""
    t = t or CrossThresholds()
    covered = unified.groupBy("organization").agg(F.count_distinct("job_id").alias("jobs_with_evidence"))
    hiring = hiring_signals.groupBy("organization").agg(F.count(F.lit(1)).alias("hiring_signal_count"))
    technology = technology_signals.groupBy("organization").agg(F.count(F.lit(1)).alias("technology_signal_count"))
    base = (
        tech_snapshot.select("organization", "total_jobs", "enriched_jobs", "technology_observation_count", "observation_start", "observation_end")
        .join(covered, "organization", "left").join(hiring, "organization", "left").join(technology, "organization", "left")
        .na.fill(0, ["jobs_with_evidence", "hiring_signal_count", "technology_signal_count"])
        .withColumns({"hiring_evidence_coverage": ratio("jobs_with_evidence", "total_jobs"), "enrichment_coverage": ratio("enriched_jobs", "total_jobs")})
    )
    return gated(base, t)


def gated(base: DataFrame, t: CrossThresholds) -> DataFrame:
    span = F.coalesce(days_between("observation_end", "observation_start"), F.lit(0))
    passes = (
        (F.col("total_jobs") >= t.minimum_total_jobs)
        & (F.col("enriched_jobs") >= t.minimum_enriched_jobs)
        & (F.col("enrichment_coverage") >= t.minimum_enrichment_coverage)
        & (F.col("technology_observation_count") >= t.minimum_technology_contributors)
        & (span >= t.minimum_observation_days)
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("total_jobs") < t.minimum_total_jobs, F.lit("The observed hiring sample is below the configured minimum.")),
            F.when(F.col("enriched_jobs") < t.minimum_enriched_jobs, F.lit("The enriched hiring sample is below the configured minimum for cross-domain signals.")),
            F.when(F.col("enrichment_coverage") < t.minimum_enrichment_coverage, F.lit("Technology enrichment coverage is below the configured reliability threshold; broader cross-domain claims are withheld.")),
            F.when(F.col("technology_observation_count") < t.minimum_technology_contributors, F.lit("Too few technology observations are available for independent cross-domain support.")),
            F.when(span < t.minimum_observation_days, F.lit("The observation period is shorter than the configured minimum.")),
        )
    )
    return base.withColumns({"passes": passes, "limitations": F.array_distinct(F.concat(notes, signal_limitations(t)))})


def signal_limitations(t: CrossThresholds) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("enrichment_coverage") < 1, F.lit("Technology enrichment covers only a subset of observed hiring records.")),
            F.when(F.lit(t.single_source_data), F.lit("Evidence currently derives from a single public hiring source.")),
            F.lit("Cross-domain overlap is observational and does not establish causation or organizational intent."),
            F.lit("Hiring evidence does not prove production technology deployment."),
        )
    )


# --- gates and overlaps inside the job row ----------------------------------------------------
#
# A job carries its groups as keys; the groups, signals and units of its organization that pass their own gates
# come to it as one short array, written first so that the planner knows how small it is and never sends the jobs
# to all tasks instead. A job's hits are places in that array: pairs of places are made inside the row and summed
# map-side, and names are attached to the few counted pairs. No job meets another job.

SEP = "\u0001"
SALTS = 32  # a large organization's jobs meet its gates in so many groups
GROUP_FAMILIES = ("total", "with_capability", "capability", "city", "leadership")


def _key(*parts) -> Column:
    return F.concat_ws(SEP, F.lit(""), *[F.coalesce(F.lit(part) if isinstance(part, str) else part, F.lit("")) for part in parts])


def tagged_jobs(rows: DataFrame, names=L.TECHNOLOGY_NAMES, categories=L.TECHNOLOGY_CATEGORIES) -> DataFrame:
    """``organization, job_id, evidence_id, tags, technologies`` of jobs with evidence (``enriched_jobs``).

    Tags are the keys of all groups the job belongs to: hiring and technology facets, the business unit of its
    record and the technologies its enrichment names.
    """
    e = F.col("enrichment")
    unit_value = F.when(e.isNotNull(), e["business_unit"]).otherwise(F.col("business_unit"))
    named = F.array_distinct(F.coalesce(e["technologies"], F.array().cast("array<string>")))
    hiring = F.transform(facet_array(SUPPORT_FAMILIES), lambda f: _key("h", f["family"], f["value"]))
    technology = F.transform(tech_facet_array(categories), lambda f: _key("t", f["family"], f["label"], f["technology"]))
    unit_key = F.when(unit_value != "", F.array(_key("u", unit_value))).otherwise(F.array().cast("array<string>"))
    return observed(rows, names).select(
        "organization", "job_id", "evidence_id", *(["sole"] if "sole" in rows.columns else []), F.array_distinct(chained(hiring, technology, unit_key, F.transform(named, lambda n: _key("r", n)))).alias("tags"),
        F.when(F.size(unit_key) > 0, unit_value).alias("unit"), named.alias("technologies"),
    )


def _gates(frame: DataFrame, kind: str, side: str, family, subject: str, key: Column, size, concentration, signal_id=None) -> DataFrame:
    return frame.select("organization", F.lit(kind).alias("kind"), F.lit(side).alias("side"), family.alias("family"), F.col(subject).cast("string").alias("subject"), key.alias("key"),
                        F.col(size).cast("long").alias("size") if size else F.lit(None).cast("long").alias("size"), concentration.cast("double").alias("concentration"),
                        F.col(signal_id).alias("signal_id") if signal_id else F.lit(None).cast("string").alias("signal_id"))


def hiring_gates(counts: DataFrame, context: DataFrame, t: CrossThresholds) -> DataFrame:
    """Concentrated capabilities, cities and leadership roles of organizations that pass the global gate."""
    totals = counts.groupBy("organization").agg(
        F.max(F.when(F.col("family") == "total", F.col("job_count"))).alias("_total"), F.coalesce(F.max(F.when(F.col("family") == "with_capability", F.col("job_count"))), F.lit(0)).alias("_classified"),
    ).join(context.filter("passes").select("organization"), "organization", "left_semi")
    base = F.when(F.col("family") == "capability", F.col("_classified")).otherwise(F.col("_total"))
    groups = counts.filter(F.col("family").isin("capability", "city", "leadership")).join(totals, "organization").withColumn("_share", unit(pct("job_count", base) / 100))
    groups = groups.filter((F.col("job_count") >= t.minimum_hiring_contributors) & (F.col("_share") >= t.minimum_domain_concentration))
    return _gates(groups, "group", "hiring", F.col("family"), "value", _key("h", F.col("family"), F.col("value")), "job_count", F.col("_share"))


def technology_gates(tech_counts: DataFrame, context: DataFrame, t: CrossThresholds) -> DataFrame:
    """Concentrated normalised technologies (share of enriched jobs, clamped)."""
    share = unit(F.least(ratio("job_count", "enriched_jobs") * 100, F.lit(100.0)) / 100)
    groups = with_tech_totals(tech_counts).filter("family = 'technology'").join(context.filter("passes").select("organization"), "organization", "left_semi").withColumn("_share", share)
    groups = groups.filter((F.col("job_count") >= t.minimum_technology_contributors) & (F.col("_share") >= t.minimum_domain_concentration))
    return _gates(groups, "group", "technology", F.lit("technology"), "technology", _key("t", F.col("family"), F.col("label"), F.col("technology")), "job_count", F.col("_share"))


def unit_gates(tagged: DataFrame, context: DataFrame, t: CrossThresholds) -> DataFrame:
    """Business units that hold enough of an organization's jobs."""
    units = tagged.filter("unit IS NOT NULL").groupBy("organization", "unit").agg(F.count(F.lit(1)).alias("size"))
    units = units.join(context.filter("passes").select("organization", "total_jobs"), "organization").withColumn("_share", ratio("size", "total_jobs"))
    units = units.filter((F.col("size") >= t.minimum_hiring_contributors) & (F.col("_share") >= t.minimum_domain_concentration))
    return _gates(units, "unit", "hiring", F.lit("business_unit"), "unit", _key("u", F.col("unit")), "size", F.col("_share"))


def signal_gates(hiring_signals: DataFrame, technology_signals: DataFrame, context: DataFrame, t: CrossThresholds | None = None) -> DataFrame:
    """Signals of both domains by the group that supports them; with thresholds only strong ones."""
    open_orgs = context.filter("passes").select("organization")
    parts = []
    for side, frame, key in (
        ("hiring", hiring_signals, _key("h", F.col("family"), F.col("value"))),
        ("technology", technology_signals, _key("t", F.col("family"), F.col("label"), F.col("technology"))),
    ):
        strong = frame.join(open_orgs, "organization", "left_semi") if t is None else frame.filter(F.col("strength") >= t.minimum_domain_concentration).join(open_orgs, "organization", "left_semi")
        parts.append(_gates(strong, "signal", side, F.lit("cluster"), "title", key, None, F.col("strength"), "signal_id"))
    return parts[0].unionByName(parts[1])


def listed_gates(gates: DataFrame) -> DataFrame:
    """``organization, _gates``: the gates of every organization as one array with their places, written once.

    Gated groups are few per organization, as each holds a minimum share of its jobs.
    """
    listed = gates.groupBy("organization").agg(F.collect_list(F.struct(*[c for c in gates.columns if c != "organization"])).alias("_gates"))
    placed = F.transform("_gates", lambda g, at: F.struct(at.cast("int").alias("at"), *[g[c].alias(c) for c in gates.columns if c != "organization"]))
    return stage(listed.select("organization", placed.alias("_gates")), "gates")


def with_listed(jobs: DataFrame, listed: DataFrame) -> DataFrame:
    """Jobs with the listed columns of their organization; a job meets one row."""
    salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return jobs.withColumn("_salt", F.pmod(F.xxhash64("job_id"), F.lit(SALTS)).cast("int")).join(salted, ["organization", "_salt"]).drop("_salt")


def _places(kind: str, side: str | None = None) -> Column:
    """Places of the hit gates of one kind."""
    wanted = lambda g: (g["kind"] == kind) if side is None else (g["kind"] == kind) & (g["side"] == side)
    return F.transform(F.filter("hits", wanted), lambda g: g["at"])


def with_hits(tagged: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds ``hits``: the gates of the job's organization that one of its tags opens.

    Gates are looked up among the few tags that are keys at all, which are hashed once per job.
    """
    keyed = F.array_intersect("tags", F.col("_gates.key"))
    hits = bound(keyed, lambda keys: F.filter("_gates", lambda g: F.array_contains(keys, g["key"])))
    return with_listed(tagged, listed).withColumn("hits", hits).drop("_gates")


PAIR = [
    "family", "primary_subject", "related_subject", "hiring_size", "technology_size", "hiring_concentration", "technology_concentration",
    "hiring_signal_id", "technology_signal_id", "left_key", "right_key",
]
ALONE, NAMED = -1, -2  # in place of a technology gate: a signal by itself, a technology that a unit's job names


def _named_pairs(counted: DataFrame, listed: DataFrame) -> DataFrame:
    """Counted pairs of places with the gates' own columns."""
    h, t = F.try_element_at("_gates", F.col("left") + 1), F.when(F.col("right") >= 0, F.try_element_at("_gates", F.greatest(F.col("right"), F.lit(0)) + 1))
    gated, name = F.col("right") >= 0, F.col("named")
    values = [
        F.when(F.col("right") == ALONE, F.lit("signal")).otherwise(h["family"]), h["subject"], F.when(gated, t["subject"]).otherwise(name), h["size"], t["size"], h["concentration"], t["concentration"],
        h["signal_id"], t["signal_id"], h["key"], F.when(gated, t["key"]).otherwise(_key("r", name)),
    ]
    return counted.join(listed, "organization").select("organization", *[v.alias(n) for v, n in zip(values, PAIR)], "overlap", "evidence_count")


COUNTED = "organization string, left int, right int, named string, n long, own long"
MATRIX_CELLS = 4_000_000  # pairs of keys of all organizations that a task counts in one table
NAMED_PAIRS = 100_000  # unit and technology names a task holds before it passes their sums on


class _OrganizationPairs:
    """Sums of one organization's pairs within a task: gate keys met together, and technologies that a unit's jobs name."""

    def __init__(self, gates):
        gates = [g for g in gates if g["key"] is not None]
        self.keys = sorted({g["key"] for g in gates})
        self.key_set = pa.array(self.keys, pa.string())
        place = {k: i for i, k in enumerate(self.keys)}
        of = lambda kind, side=None: [(g["at"], place[g["key"]]) for g in gates if g["kind"] == kind and side in (None, g["side"])]
        self.crossed = [(of(kind, "hiring"), of(kind, "technology")) for kind in ("group", "signal")]
        self.alone, self.units = of("signal", "hiring") + of("signal", "technology"), of("unit", "hiring")
        self.unit_keys = sorted({k for _, k in self.units})
        self.met = np.zeros((2, len(self.keys), len(self.keys)), np.int64)
        self.named: dict[tuple, np.ndarray] = {}

    def add(self, owned: np.ndarray, parents: np.ndarray, tags, name_parents: np.ndarray, names) -> None:
        """Rows of a batch, by whether they cite evidence; tags and names by their row."""
        found = pc.index_in(tags, value_set=self.key_set)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        held = np.zeros((len(owned), len(self.keys)), np.float32)
        held[parents[hit], found.drop_null().to_numpy()] = 1
        # A batch has fewer rows than float32 counts exactly.
        self.met[0] += np.rint(held.T @ held).astype(np.int64)
        own = held[owned]
        self.met[1] += np.rint(own.T @ own).astype(np.int64)
        if self.unit_keys and len(names):
            coded = names.dictionary_encode(null_encoding="encode")
            codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for key in self.unit_keys:
                of_unit = held[name_parents, key] > 0
                sums = np.bincount(codes[of_unit], minlength=len(words)), np.bincount(codes[of_unit & owned[name_parents]], minlength=len(words))
                for code in np.flatnonzero(sums[0]):
                    total = self.named.setdefault((key, words[code]), np.zeros(2, np.int64))
                    total += (int(sums[0][code]), int(sums[1][code]))

    def named_rows(self) -> list[tuple]:
        at = {}
        for place, key in self.units:
            at.setdefault(key, []).append(place)
        rows = [(place, NAMED, name, int(n), int(own)) for (key, name), (n, own) in self.named.items() for place in at[key]]
        self.named = {}
        return rows

    def rows(self) -> list[tuple]:
        (n, own), out = self.met, self.named_rows()
        pairs = [(h, t, hk, tk) for hiring, technology in self.crossed for h, hk in hiring for t, tk in technology]
        pairs += [(place, ALONE, key, key) for place, key in self.alone]
        return out + [(left, right, None, int(n[a, b]), int(own[a, b])) for left, right, a, b in pairs if n[a, b]]


def paired_within_tasks(tagged: DataFrame, gates: dict[str, list]) -> DataFrame:
    """``COUNTED`` rows of jobs that need no comparison with others: every task sums its pairs, so few rows are shuffled.

    Tags are looked up by Arrow; the pairs of a batch are one product of its table of jobs and keys.
    """

    def work(batches):
        made: dict[str, _OrganizationPairs] = {}

        def sent(organization, rows):
            columns = [list(c) for c in zip(*rows)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([organization] * len(rows), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["organization", "left", "right", "named", "n", "own"])

        for batch in batches:
            organizations = batch.column(0).dictionary_encode()
            codes = organizations.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            owned = batch.column(1).to_numpy(zero_copy_only=False)
            lists = [(pc.list_parent_indices(c).to_numpy(), pc.list_flatten(c)) for c in (batch.column(2), batch.column(3))]
            for code, organization in enumerate(organizations.dictionary.to_pylist()):
                if organization not in gates:
                    continue
                if organization not in made:
                    made[organization] = _OrganizationPairs(gates[organization])
                own = codes == code
                row = np.cumsum(own) - 1
                parts = []
                for parents, values in lists:
                    inside = own[parents]
                    parts += [row[parents[inside]], values.filter(pa.array(inside))]
                made[organization].add(owned[own], *parts)
                if len(made[organization].named) > NAMED_PAIRS:
                    yield sent(organization, made[organization].named_rows())
        for organization, sums in made.items():
            rows = sums.rows()
            if rows:
                yield sent(organization, rows)

    return tagged.select("organization", F.col("evidence_id").isNotNull().alias("own"), "tags", "technologies").mapInArrow(work, COUNTED)


def few_gates(listed: DataFrame) -> dict[str, list] | None:
    """The gates by organization, if the tables of their pairs are small enough for every task; they are as a rule, as gates hold a minimum share each."""
    cells = listed.agg(F.sum(F.size("_gates").cast("long") * F.size("_gates"))).first()[0] or 0
    if cells > MATRIX_CELLS:
        return None
    slim = listed.filter("organization IS NOT NULL").select("organization", F.transform("_gates", lambda g: F.struct(*[g[c].alias(c) for c in ("at", "kind", "side", "key")])).alias("g"))
    return {r["organization"]: r["g"] for r in slim.collect()}


def overlap_counts(tagged: DataFrame, gates: DataFrame) -> DataFrame:
    """Shared jobs and distinct evidence of every pair of gated groups, of units and technologies, and of signals.

    ``signal`` rows give the evidence behind each signal by itself. Evidence that one job alone cites needs no
    comparison with others, so its pairs are summed within the task; only pairs of shared evidence are made distinct.
    """
    listed = listed_gates(gates)
    few = few_gates(listed) if "sole" in tagged.columns else None
    counted = _pairs_of_rows(tagged if few is None else tagged.filter("NOT sole"), listed)
    if few is not None:
        alone = paired_within_tasks(tagged.filter("sole"), few).withColumnsRenamed({"n": "overlap", "own": "evidence_count"})
        counted = alone.unionByName(counted).groupBy("organization", "left", "right", "named").agg(F.sum("overlap").alias("overlap"), F.sum("evidence_count").alias("evidence_count"))
    return _named_pairs(counted, listed)


def _pairs_of_rows(tagged: DataFrame, listed: DataFrame) -> DataFrame:
    """Jobs and distinct evidence of every pair of places, by a row per job and pair."""
    named = F.when(F.size(_places("unit")) > 0, F.col("technologies")).otherwise(F.array().cast("array<string>"))
    kinds = {"gh": ("group", "hiring"), "gt": ("group", "technology"), "sh": ("signal", "hiring"), "st": ("signal", "technology"), "u": ("unit", "hiring")}
    sole = "sole" in tagged.columns
    slim = with_hits(tagged, listed).select("organization", "job_id", "evidence_id", *(["sole"] if sole else []), *[_places(*of).alias(c) for c, of in kinds.items()], named.alias("named"))
    citing = Window.partitionBy("organization", "evidence_id", F.when(F.col("evidence_id").isNull(), F.col("job_id")))
    # Evidence may be compared without need, so rows that know to be sole spare all others the count.
    marked = slim.withColumn("_shared", ~F.col("sole") if sole else F.col("evidence_id").isNotNull() & (F.count(F.lit(1)).over(citing) > 1))
    no_name = F.lit(None).cast("string")
    pair = lambda left, right, name=no_name: F.struct(left.alias("left"), right.alias("right"), name.alias("named"))
    cross = lambda left, right: F.flatten(F.transform(left, lambda h: F.transform(right, lambda t: pair(h, t))))
    units = F.flatten(F.transform("u", lambda u: F.transform("named", lambda n: pair(u, F.lit(NAMED), n))))
    alone = F.transform(chained("sh", "st"), lambda g: pair(g, F.lit(ALONE)))
    made = chained(cross("gh", "gt"), cross("sh", "st"), units, alone)
    rows = marked.select("organization", "evidence_id", F.when(F.col("_shared"), F.col("evidence_id")).alias("_cited"), F.explode_outer(made).alias("p")).filter("p IS NOT NULL")
    pairs = ["organization", "left", "right", "named"]
    cited = rows.groupBy("organization", "p.left", "p.right", "p.named", "_cited").agg(F.count(F.lit(1)).alias("n"), F.count("evidence_id").alias("_own"))
    return cited.groupBy(*pairs).agg(F.sum("n").alias("overlap"), F.sum(F.when(F.col("_cited").isNull(), F.col("_own")).otherwise(1)).alias("evidence_count"))


def overlaps(counts: DataFrame, context: DataFrame, t: CrossThresholds) -> DataFrame:
    """Counted pairs whose two sides both pass: the technology side of a unit is its own overlap, a cluster counts evidence.

    The counts, few, are written first: five plans read them, and each would make the pairs of all jobs again.
    """
    counts = stage(counts, "overlap-counts")
    groups = counts.filter(~F.col("family").isin("business_unit", "cluster", "signal"))
    units = counts.filter("family = 'business_unit'").join(context.select("organization", "enriched_jobs"), "organization").withColumns(
        {"technology_size": F.col("overlap"), "technology_concentration": ratio("overlap", "enriched_jobs")}
    ).filter((F.col("technology_size") >= t.minimum_technology_contributors) & (F.col("technology_concentration") >= t.minimum_domain_concentration)).select(*counts.columns)
    sizes = counts.filter("family = 'signal'").select(F.col("hiring_signal_id").alias("_id"), F.col("evidence_count").alias("_size"))
    clusters = counts.filter("family = 'cluster'").withColumn("overlap", F.col("evidence_count"))
    for side, minimum in (("hiring", t.minimum_hiring_contributors), ("technology", t.minimum_technology_contributors)):
        clusters = clusters.join(sizes.filter(F.col("_size") >= minimum), F.col(f"{side}_signal_id") == F.col("_id")).withColumn(f"{side}_size", F.col("_size")).drop("_id", "_size")
    return groups.unionByName(units).unionByName(clusters.select(*counts.columns))


def with_identity(rows: DataFrame, context: DataFrame, t: CrossThresholds) -> DataFrame:
    """Attach the alignment id, type and period to pair rows."""
    period = context.select("organization", "observation_start", "observation_end", "enrichment_coverage")
    kind = F.col("signal_type")
    typed = F.lit(None).cast("string")
    for family, name in TYPES.items():
        typed = F.when(F.col("family") == family, F.lit(name)).otherwise(typed)
    primary = F.when(F.col("family") == "leadership", F.lit("leadership hiring")).otherwise(F.col("primary_subject"))
    identity = F.concat_ws(
        "|", "organization", kind, "primary_subject", "related_subject",
        F.col("observation_start").cast("string"), F.col("observation_end").cast("string"), F.lit(t.configuration_version),
    )
    return rows.join(period, "organization").withColumns({"signal_type": typed, "primary_subject": primary}).withColumn(
        "signal_id", uuid5(F.concat(F.lit("cross-domain:"), identity))
    )


def alignments(pairs: DataFrame, context: DataFrame, thresholds: CrossThresholds | None = None) -> DataFrame:
    """Overlap test, score, identity and text of every counted pair (``overlaps``)."""
    t = thresholds or CrossThresholds()
    tested = pairs.filter(
        (F.col("overlap") >= t.minimum_unique_cross_domain_contributors) & (F.col("evidence_count") >= t.minimum_unique_cross_domain_contributors)
    )
    named = with_identity(tested, context, t)
    evidence = unit(F.col("evidence_count") / F.col("overlap"))
    overlap_strength = unit(F.col("overlap") / F.greatest("hiring_size", "technology_size"))
    primary, related, n = F.col("primary_subject"), F.col("related_subject"), F.col("overlap")
    family = F.col("family")
    title = (
        F.when(family == "capability", F.format_string("Observed overlap between %s hiring and %s", primary, related))
        .when(family.isin("city", "business_unit"), F.format_string("Observed %s hiring overlap in %s", related, primary))
        .when(family == "leadership", F.concat(F.lit("Observed leadership hiring overlap with "), related))
        .otherwise(F.lit("Observed overlap between hiring and technology signals"))
    )
    summary = (
        F.when(family == "capability", F.format_string(
            "Within the observed hiring evidence, %s classifications overlap with %s observations across %d independently contributing job records. This relationship is observational and does not establish a strategy, initiative, or causal link.", primary, related, n))
        .when(family == "city", F.format_string(
            "Current evidence shows overlap between hiring activity in %s and %s observations across %d independently contributing job records. This does not prove location-level adoption or organizational intent.", primary, related, n))
        .when(family == "business_unit", F.format_string(
            "Among sufficiently supported hiring records, %s observations overlap with %s across %d independently contributing jobs. This evidence does not establish business-unit deployment or intent.", related, primary, n))
        .when(family == "leadership", F.format_string(
            "The observed sample contains leadership-classified hiring and %s observations across %d independently contributing jobs. This does not establish leadership intent or technology direction.", related, n))
        .otherwise(F.format_string(
            "Within the observed hiring evidence, an existing hiring signal overlaps with an existing technology signal across %d independently contributing jobs. This higher-order pattern remains observational and non-causal.", n))
    )
    sufficiency = unit(n / (t.minimum_unique_cross_domain_contributors * 2))
    return named.select(
        "organization", "signal_id", "signal_type", title.alias("title"), summary.alias("summary"), "primary_subject", "related_subject", "family",
        "observation_start", "observation_end",
        unit((F.col("hiring_concentration") + F.col("technology_concentration") + overlap_strength) / 3).alias("strength"),
        unit((F.col("enrichment_coverage") + evidence + sufficiency) / 3).alias("confidence"),
        evidence.alias("evidence_coverage"),
        F.col("hiring_size").alias("hiring_contributor_count"), F.col("technology_size").alias("technology_contributor_count"),
        "overlap", "evidence_count", signal_limitations(t).alias("limitations"), "hiring_signal_id", "technology_signal_id", "left_key", "right_key",
    )


def listed_alignments(signals: DataFrame) -> DataFrame:
    """``organization, _ids, _keys, _lefts``: signal ids, all keys, and per key of a hiring side the other sides with the id's place, written once."""
    placed = signals.groupBy("organization").agg(
        F.sort_array(F.collect_set("signal_id")).alias("_ids"), F.collect_set(F.struct("left_key", "right_key", "signal_id")).alias("_sides")
    )
    lefts = F.transform(F.array_distinct(F.col("_sides.left_key")), lambda k: F.struct(
        k.alias("key"),
        F.transform(F.filter("_sides", lambda s: s["left_key"] == k), lambda s: F.struct(s["right_key"].alias("key"), (F.array_position("_ids", s["signal_id"]) - 1).cast("int").alias("at"))).alias("rights"),
    ))
    keys = F.array_union("_sides.left_key", "_sides.right_key")
    return stage(placed.select("organization", "_ids", keys.alias("_keys"), lefts.alias("_lefts")), "alignments")


def _aligned() -> Column:
    """Places of the alignments whose two sides are among the job's ``_open`` keys."""
    held = lambda s: F.array_contains(F.col("_open"), s["key"])
    return F.array_distinct(F.flatten(F.transform(F.filter("_lefts", held), lambda l: F.transform(F.filter(l["rights"], held), lambda r: r["at"]))))


FEW_SIDES = 100_000  # pairs of sides that every task holds
CELLS = 4_000_000  # cells of a table of jobs and keys, sides or signals at a time


class _Sides:
    """Keys of one organization's alignments, the places of their two sides among them, and of the alignments, in order."""

    def __init__(self, lefts, further=()):
        sides = sorted({(r["at"], l["key"], r["key"]) for l in lefts for r in l["rights"] if l["key"] is not None and r["key"] is not None})
        self.keys = sorted({k for _, *both in sides for k in both} | {*further})
        self.key_set, self.place = pa.array(self.keys, pa.string()), {k: i for i, k in enumerate(self.keys)}
        self.at = np.array([at for at, _, _ in sides], np.int32)
        self.left, self.right = (np.array([self.place[side[i]] for side in sides], np.int64) for i in (1, 2))
        self.first = np.flatnonzero(np.r_[True, self.at[1:] != self.at[:-1]]) if sides else np.zeros(0, np.int64)
        self.places = self.at[self.first]

    def held(self, tags) -> np.ndarray:
        """Which keys every row holds."""
        found = pc.index_in(pc.list_flatten(tags), value_set=self.key_set)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        table = np.zeros((len(tags), len(self.keys)), bool)
        table[pc.list_parent_indices(tags).to_numpy()[hit], found.drop_null().to_numpy()] = True
        return table

    def aligned(self, held: np.ndarray) -> np.ndarray:
        """Which alignments (``places``) every row holds both sides of."""
        both = held[:, self.left] & held[:, self.right]
        return both if len(self.first) == len(self.at) else np.logical_or.reduceat(both, self.first, axis=1)


def _rows_of_organizations(batch, known, width):
    """``(organization, rows)`` of the known organizations of a batch, few enough rows at a time for ``width`` columns each."""
    organizations = batch.column(0).dictionary_encode()
    codes = organizations.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for code, organization in enumerate(organizations.dictionary.to_pylist()):
        if organization in known:
            rows, most = np.flatnonzero(codes == code), max(1, CELLS // max(1, width(organization)))
            yield from ((organization, batch.take(pa.array(rows[i : i + most]))) for i in range(0, len(rows), most))


def few_sides(listed: DataFrame) -> dict[str, list] | None:
    """The sides of all alignments by organization, if every task can hold them."""
    sides = listed.agg(F.sum(F.aggregate("_lefts", F.lit(0).cast("long"), lambda n, l: n + F.size(l["rights"])))).first()[0] or 0
    if sides > FEW_SIDES:
        return None
    return {r["organization"]: r["_lefts"] for r in listed.filter("organization IS NOT NULL").select("organization", "_lefts").collect()}


def aligned_within_tasks(tagged: DataFrame, sides: dict[str, list]) -> DataFrame:
    """``job_alignments`` of sole rows, which are distinct already: both sides of every alignment are looked up among a batch's tags."""

    def work(batches):
        made: dict[str, _Sides] = {}
        for batch in batches:
            for organization, rows in _rows_of_organizations(batch, sides, lambda o: sum(len(l["rights"]) for l in sides[o])):
                if organization not in made:
                    made[organization] = _Sides(sides[organization])
                own = made[organization]
                met = own.aligned(own.held(rows.column(3)))
                counts = met.sum(axis=1)
                some = np.flatnonzero(counts)
                offsets = np.r_[0, np.cumsum(counts[some])].astype(np.int32)
                at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own.places[np.nonzero(met)[1]], pa.int32()))
                kept = rows.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], at], ["organization", "job_id", "evidence_id", "at"])

    return tagged.select("organization", "job_id", "evidence_id", "tags").mapInArrow(work, "organization string, job_id string, evidence_id string, at array<int>")


def job_alignments(tagged: DataFrame, listed: DataFrame) -> DataFrame:
    """``organization, job_id, evidence_id, at``: places of a job's alignments, one row per job and evidence.

    Long rows are made after this, so that only a job's places are shuffled to make its rows distinct; those of sole
    rows are distinct already and stay in their task.
    """
    few = few_sides(listed) if "sole" in tagged.columns else None
    if few is None:
        return _alignments_of_rows(tagged, listed)
    return aligned_within_tasks(tagged.filter("sole"), few).unionByName(_alignments_of_rows(tagged.filter("NOT sole"), listed))


def _alignments_of_rows(tagged: DataFrame, listed: DataFrame) -> DataFrame:
    """``job_alignments`` by the lists of every row's organization."""
    met = with_listed(tagged.select("organization", "job_id", "evidence_id", "tags"), listed.drop("_ids")).withColumn("_open", F.array_intersect("tags", "_keys"))
    found = met.select("organization", "job_id", "evidence_id", _aligned().alias("at"))
    return found.groupBy("organization", "job_id", "evidence_id").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at")).filter(F.size("at") > 0)


def alignment_support(tagged: DataFrame, signals: DataFrame) -> DataFrame:
    """Contributing records of every cross-domain signal, one row each: jobs that hold both its sides."""
    listed = listed_alignments(signals)
    named = with_listed(job_alignments(tagged, listed), listed.select("organization", "_ids"))
    return named.select("organization", F.explode(F.transform("at", lambda i: F.element_at("_ids", i + 1))).alias("signal_id"), "job_id", "evidence_id")


def alignment_citations(tagged: DataFrame, signals: DataFrame) -> DataFrame:
    """``evidence_id, cross_domain_signal_count``: how many cross-domain signals cite each evidence."""
    found = job_alignments(tagged, listed_alignments(signals))
    # A signal belongs to one organization, so its places are counted per organization.
    per = found.groupBy("organization", "evidence_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("n"))
    return per.groupBy("evidence_id").agg(F.sum("n").alias("cross_domain_signal_count"))


WORD = 62  # signals to a bit word


WORDS = "organization string, a int, word int, bits long"


def related_within_tasks(tagged: DataFrame, sides: dict[str, list], gates: dict[str, list]) -> DataFrame:
    """``WORDS``: the signals met in a job with each alignment, or-ed by every task as one table of alignments and signals."""

    def work(batches):
        made: dict[str, tuple] = {}
        for batch in batches:
            width = lambda o: max(sum(len(l["rights"]) for l in sides[o]), len(gates[o]))
            for organization, rows in _rows_of_organizations(batch, sides.keys() & gates.keys(), width):
                if organization not in made:
                    signals = [(g["at"], g["key"]) for g in gates[organization] if g["kind"] == "signal" and g["key"] is not None]
                    own = _Sides(sides[organization], [k for _, k in signals])
                    made[organization] = own, [at for at, _ in signals], np.array([own.place[k] for _, k in signals], np.int64), np.zeros((len(own.places), len(signals)), bool)
                own, _, keys, met = made[organization]
                if met.all():
                    continue
                held = own.held(rows.column(1))
                met |= own.aligned(held).T.astype(np.float32) @ held[:, keys].astype(np.float32) > 0
        for organization, (own, ats, _, met) in made.items():
            bits = np.zeros((len(own.places), max(ats, default=0) // WORD + 1), np.int64)
            for column, at in enumerate(ats):
                bits[:, at // WORD] |= met[:, column].astype(np.int64) << (at % WORD)
            row, word = np.nonzero(bits)
            columns = pa.array([organization] * len(row), pa.string()), pa.array(own.places[row], pa.int32()), pa.array(word, pa.int32()), pa.array(bits[row, word], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns], ["organization", "a", "word", "bits"])

    return tagged.select("organization", "tags").mapInArrow(work, WORDS)


def _related_of_rows(tagged: DataFrame, listed: DataFrame, aligned: DataFrame) -> DataFrame:
    """``WORDS`` by a row per job, alignment and word of signals."""
    met = with_listed(with_hits(tagged.select("organization", "job_id", "tags"), listed), aligned.drop("_ids")).withColumn("_open", F.array_intersect("tags", "_keys"))
    at = met.select("organization", _aligned().alias("a"), _places("signal").alias("s"))
    words = F.transform(F.array_distinct(F.transform("s", _word)), lambda w: F.struct(w.alias("word"), F.aggregate(F.filter("s", lambda s: _word(s) == w), F.lit(0).cast("long"), lambda acc, s: acc.bitwiseOR(_bit(s))).alias("bits")))
    worded = at.filter((F.size("a") > 0) & (F.size("s") > 0)).select("organization", "a", words.alias("w"))
    made = F.flatten(F.transform("a", lambda a: F.transform("w", lambda w: F.struct(a.alias("a"), w["word"].alias("word"), w["bits"].alias("bits")))))
    return worded.select("organization", F.explode_outer(made).alias("r")).filter("r IS NOT NULL").select("organization", "r.*")


def _word(place) -> Column:
    return F.floor(place / WORD).cast("int")


def _bit(place) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))


def related_signals(tagged: DataFrame, signals: DataFrame, domain_signals: DataFrame) -> DataFrame:
    """``organization, signal_id, domain, related_id``: signals of both domains that share evidence with an alignment.

    A cluster relates to its own two signals alone. ``domain_signals`` are ``signal_gates`` without thresholds. The
    signals of a job are bits, or-ed within every task where the tables of sides and signals are small enough.
    """
    listed, aligned = listed_gates(domain_signals), listed_alignments(signals.filter("family <> 'cluster'"))
    cells = aligned.join(listed, "organization").agg(F.sum(F.size("_ids").cast("long") * F.size("_gates"))).first()[0] or 0
    sides = few_sides(aligned) if cells <= MATRIX_CELLS else None
    gates = few_gates(listed) if sides is not None else None
    worded = _related_of_rows(tagged, listed, aligned) if gates is None else related_within_tasks(tagged, sides, gates)
    sums = worded.groupBy("organization", "a", "word").agg(F.bit_or("bits").alias("bits"))
    found = sums.join(aligned.select("organization", "_ids"), "organization").join(listed, "organization").select(
        "organization", F.element_at("_ids", F.col("a") + 1).alias("signal_id"),
        F.explode(F.filter("_gates", lambda g: (_word(g["at"]) == F.col("word")) & (F.col("bits").bitwiseAND(_bit(g["at"])) != 0))).alias("g"),
    ).select("organization", "signal_id", F.col("g.side").alias("domain"), F.col("g.signal_id").alias("related_id")).distinct()
    own = signals.filter("family = 'cluster'").select(
        "organization", "signal_id", F.explode(F.array(F.struct(F.lit("hiring").alias("domain"), F.col("hiring_signal_id").alias("related_id")), F.struct(F.lit("technology").alias("domain"), F.col("technology_signal_id").alias("related_id")))).alias("r"),
    )
    return found.unionByName(own.select("organization", "signal_id", "r.*"))
