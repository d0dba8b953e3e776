"""The search path over a pool of materials: look-ups, filters, index scans, coverage, flattening.

A pool is a table (id, article_id, status, release_channel, is_primary, quality_score,
updated_at, primary_family, families array<string>, subtypes array<string>, fit_scores
map<string, double>, genre, structure, text …).  A filter that is None is left out, so a
search plan holds only what was asked for and Catalyst can push it to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a review after which a material may serve.
SERVABLE = ("auto_tagged", "review_confirmed")
#: Rows that the fallback scan looks at, at least.
FALLBACK_ROWS = 1600


def equal(rows: DataFrame, **wanted: object) -> DataFrame:
    """``rows`` with each column equal to what is wanted; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def by_key(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys`` (a table of one column), each once."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def pool_search(pool: DataFrame, least_fit: float | None = None, subtype: str | None = None, **wanted: object) -> DataFrame:
    """Materials by equal columns, a subtype among theirs and the best of their fit scores."""
    rows = equal(pool, **wanted)
    if subtype is not None:
        rows = rows.where(F.array_contains("subtypes", subtype))
    if least_fit is not None:
        rows = rows.where(F.coalesce(F.array_max(F.map_values("fit_scores")), F.lit(0.0)) >= least_fit)
    return rows


def index_scan(pool: DataFrame, family: str, limit: int, **wanted: object) -> DataFrame:
    """The best primary materials that are indexed for a family: the limit counts rows of the family."""
    rows = equal(pool.where("is_primary"), **wanted).where(F.array_contains("families", family))
    return rows.orderBy(F.desc("quality_score"), F.desc("updated_at"), "id").limit(limit)


def fallback_scan(pool: DataFrame, reviews: DataFrame, family: str, candidate_limit: int = 20) -> DataFrame:
    """Of the best promoted stable materials those of a family with no review or a servable one.

    Unlike in ``index_scan`` the limit comes first: it counts rows of all families.
    """
    rows = pool.where("is_primary and status = 'promoted' and release_channel = 'stable'")
    rows = rows.orderBy(F.desc("quality_score"), F.desc("updated_at"), "id").limit(max(12 * candidate_limit, FALLBACK_ROWS))
    joined = rows.join(reviews, "id", "left").where(F.col("review_status").isNull() | F.col("review_status").isin(*SERVABLE))
    return joined.where(F.array_contains("families", family))


def front_filters(
    rows: DataFrame, topic: str | None = None, direction: str | None = None, genre: str | None = None, structure: str | None = None, haystack: Sequence[str] = ("text", "title", "core_object")
) -> DataFrame:
    """Rows of a genre and structure that hold topic and direction anywhere in their haystack."""
    rows = equal(rows, genre=genre or None, structure=structure or None)
    hay = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in haystack))
    for word in (topic, direction):
        if word and word.strip():
            rows = rows.where(hay.contains(word.strip()))
    return rows


def promotion_verdicts(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """requests (id, status, release_channel) with whether each may be carried out.

    Promotion to the stable channel needs a review that lets the material serve.
    """
    stable = (F.col("status") == "promoted") & (F.col("release_channel") == "stable")
    return requests.join(reviews, "id", "left").withColumn("allowed", ~stable | F.coalesce(F.col("review_status").isin(*SERVABLE), F.lit(False)))


def question_types(pool: DataFrame, types: DataFrame) -> DataFrame:
    """(id, question_type, stable) once for each type that a material's families cover; types: (family, question_type), a small table."""
    families = F.array_distinct(F.concat(F.array("primary_family"), F.coalesce("families", F.array().cast("array<string>"))))
    rows = pool.select("id", ((F.col("status") == "promoted") & (F.col("release_channel") == "stable")).alias("stable"), F.explode(families).alias("family"))
    return rows.join(types, "family").select("id", "question_type", "stable").distinct()


def type_coverage(pool: DataFrame, types: DataFrame) -> DataFrame:
    """Materials by question type, all and stable; a type that none covers counts 0."""
    counted = question_types(pool, types).groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("n_stable"))
    return types.select("question_type").distinct().join(counted, "question_type", "left").na.fill(0)


def counters(pool: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(counter, value, n) for each column, from one pass over the pool: every row is expanded to few groups and pre-aggregated."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns)))
    return pool.select(pairs.alias("x")).groupBy("x.counter", "x.value").agg(F.count(F.lit(1)).alias("n"))


def flatten_payload(materials: DataFrame, reviews: DataFrame, payload: str = "map<string, struct<task_family: string, final: double, readiness: double, penalties: map<string, double>>>") -> DataFrame:
    """One record for each material and family of its JSON payload; malformed payloads give none, missing numbers are 0."""
    parsed = materials.withColumn("x", F.from_json("payload", payload)).where("x is not null")
    flat = parsed.select("id", "article_id", F.explode("x").alias("family", "item")).where("item is not null").join(reviews, "id", "left")
    number = lambda c: F.coalesce(F.when(F.isnan(c), 0.0).otherwise(F.col(c)), F.lit(0.0))
    total = F.aggregate(F.map_values(F.coalesce("item.penalties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return flat.select(
        "id", "article_id", "family", F.coalesce(F.nullif(F.trim("item.task_family"), F.lit("")), "family").alias("task_family"), "review_status",
        number("item.final").alias("final"), number("item.readiness").alias("readiness"), F.round(total + 1e-9, 4).alias("total_penalty"), F.col("item.final").isNotNull().alias("has_scoring"),
    )


def landed_families(materials: DataFrame, votes: DataFrame, main: Sequence[str]) -> DataFrame:
    """The families a material is indexed for: those of its rules, unless a vote says otherwise about the main ones.

    materials: (id, families); votes: (id, vote_status, voted array<string>).  A vote that failed
    changes nothing; else the voted families take the place of the main ones.
    """
    joined = materials.join(votes, "id", "left")
    own = F.coalesce("families", F.array().cast("array<string>"))
    voted = F.coalesce("voted", F.array().cast("array<string>"))
    other = F.filter(own, lambda f: ~f.isin(*main))
    failed = F.col("vote_status").isNull() | ((F.size(voted) == 0) & F.col("vote_status").isin("error", "insufficient_votes"))
    return joined.withColumn("landed", F.array_sort(F.array_distinct(F.when(failed, own).otherwise(F.concat(other, voted)))))


def recommendations(penalties: DataFrame, thresholds: DataFrame, shifts: DataFrame, kept: Mapping[str, Sequence[str]]) -> DataFrame:
    """(type, name, diagnosis) of all diagnoses that call for something; kept: by type, the diagnoses that do."""
    parts = [d.where(F.col("diagnosis").isin(*kept[kind])).select(F.lit(kind).alias("type"), "name", "diagnosis") for kind, d in (("penalty", penalties), ("threshold", thresholds), ("preference", shifts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def apply_verdict(objective: Column, selected: Column, deprecated_rate: Column) -> Column:
    """Whether a policy may go to a person for review, or the first reason why not."""
    return (
        F.when(F.coalesce(objective, F.lit(0.0)) <= 0, "no_positive_proxy_objective_found")
        .when(F.coalesce(selected, F.lit(0)) == 0, "review_only_policy_without_positive_selection")
        .when(F.coalesce(deprecated_rate, F.lit(0.0)) >= 0.35, "deprecated_leakage_too_high")
        .otherwise("candidate_for_manual_review_only")
    )


def blank_position(text: Column, marks: Sequence[str] = ("____", "___", "[BLANK]", "（  ）", "( )")) -> Column:
    """opening, middle or ending by where the first kind of blank mark that occurs stands; empty without any."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    place = F.coalesce(*(F.nullif(F.position(F.lit(m), body), F.lit(0)) for m in marks)) - 1
    ratio = place / F.greatest(F.length(body), F.lit(1))
    return F.when(place.isNull(), "").when(ratio <= 0.22, "opening").when(ratio >= 0.70, "ending").otherwise("middle")


def feedback_outcomes(actions: DataFrame) -> DataFrame:
    """actions (item, action, result_status) with the four flags of an outcome."""
    repair = F.col("action").isin("minor_edit", "question_modify", "text_modify", "manual_edit", "distractor_patch")
    return actions.withColumns(
        {
            "repair_path_taken": repair,
            "accepted_as_is": F.col("action").isin("approve", "confirm") & (F.col("result_status") == "approved"),
            "revised_then_kept": repair & F.col("result_status").isin("pending_review", "approved", "generated"),
            "discarded": (F.col("action") == "discard") | (F.col("result_status") == "discarded"),
        }
    )


def failed_checks(items: DataFrame) -> DataFrame:
    """(item, check_name, threshold_name, actual, threshold) of the required checks that failed and have a threshold.

    items: (item, checks map<string, struct<required, passed, reason, actual, threshold>>).
    """
    rows = items.select("item", F.explode("checks").alias("check_name", "c")).where("c.required and c.passed = false and (c.actual is not null or c.threshold is not null)")
    return rows.select("item", "check_name", F.coalesce(F.nullif(F.trim("c.reason"), F.lit("")), "check_name").alias("threshold_name"), "c.actual", "c.threshold")


def key_changes(payloads: DataFrame) -> DataFrame:
    """keys_added and keys_lost of (id, old, rebuilt), both maps; a missing map has no keys."""
    none = F.array().cast("array<string>")
    old, new = (F.coalesce(F.map_keys(c), none) for c in ("old", "rebuilt"))
    return payloads.withColumns({"keys_added": F.array_sort(F.array_except(new, old)), "keys_lost": F.array_sort(F.array_except(old, new))})


def merged_slots(*slots: Column) -> Column:
    """One map of several, later ones winning; null maps count as empty."""
    entries = F.flatten(F.array(*(F.coalesce(F.map_entries(s), F.array().cast("array<struct<key: string, value: string>>")) for s in slots)))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def projected_slots(cards: DataFrame, context: DataFrame, strategies: DataFrame, key: str = "id") -> DataFrame:
    """Slots of each row of ``context`` (key, card, conditions array<string>): a card's own, then those of its strategies that match, in order.

    cards: (card, slots map); strategies: (card, place, needs array<string>, slots map); both small dimension tables.
    A strategy matches if all that it needs, at least one thing, is among the conditions.
    """
    held = strategies.groupBy("card").agg(F.sort_array(F.collect_list(F.struct("place", "needs", F.map_entries("slots").alias("entries")))).alias("held"))
    rows = context.join(cards, "card").join(held, "card", "left")
    none = F.array().cast("array<struct<place: int, needs: array<string>, entries: array<struct<key: string, value: string>>>>")
    match = F.filter(F.coalesce("held", none), lambda s: (F.size(s["needs"]) > 0) & (F.size(F.array_except(s["needs"], F.col("conditions"))) == 0))
    rows = rows.withColumn("match", match)
    entries = F.flatten(F.transform("match", lambda s: s["entries"]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    late = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return rows.select(key, "card", merged_slots(F.col("slots"), late).alias("slots"), F.size("match").alias("n_matched"))


def pattern_choice(rules: DataFrame, slots: DataFrame) -> DataFrame:
    """Per id the pattern with most matched rules, its score, the runner-up's, and whether the choice is clear.

    rules: (pattern, place, slot, allowed array<string>), a small dimension table; slots: (id, slots map).
    Every pattern is scored for every id in one pass over the slots, without a join: patterns live in one array.
    """
    packed = rules.groupBy("pattern", "place").agg(F.collect_list(F.struct("slot", "allowed")).alias("tests"))
    packed = packed.agg(F.sort_array(F.collect_list(F.struct("place", "pattern", "tests"))).alias("patterns")).withColumn("one", F.lit(1))
    # one row
    rows = slots.withColumn("one", F.lit(1)).join(F.broadcast(packed), "one")
    scored = F.transform(
        "patterns",
        lambda p: F.struct(
            (-F.size(F.filter(p["tests"], lambda t: F.coalesce(F.array_contains(t["allowed"], F.try_element_at(F.col("slots"), t["slot"])), F.lit(False))))).alias("by"), p["place"].alias("place"), p["pattern"].alias("pattern")
        ),
    )
    rows = rows.withColumn("s", F.array_sort(scored)).select("id", F.col("s")[0].alias("top"), F.get("s", F.lit(1)).alias("second"))
    return rows.select("id", F.col("top.pattern").alias("pattern"), (-F.col("top.by")).alias("score"), F.coalesce(-F.col("second.by"), F.lit(-1)).alias("second_score")).withColumn(
        "clear", (F.col("score") > 0) & (F.col("score") != F.col("second_score"))
    )


def difficulty_fit(rows: DataFrame, metrics: Mapping[str, tuple[float, float]]) -> DataFrame:
    """in_range, and the metrics outside their target range, in order."""
    outside = F.array_compact(F.array(*(F.when((F.col(m) < low) | (F.col(m) > high), m) for m, (low, high) in metrics.items())))
    return rows.withColumn("deviations", outside).withColumn("in_range", F.size("deviations") == 0)


def projected_difficulty(slots: Column, base: float, by_slot: Sequence[tuple[str, Mapping[str, float]]]) -> Column:
    """A metric of a pattern: its base, replaced by the value that the last listed slot with one has, cut to [0, 1]."""
    out = F.lit(float(base))
    for slot, values in by_slot:
        value = F.try_element_at(slots, F.lit(slot))
        chosen = F.lit(None).cast("double")
        for key, x in values.items():
            chosen = F.when(value == key, float(x)).otherwise(chosen)
        out = F.coalesce(chosen, out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def stitched_pairs(units: Column, least: int = 12) -> Column:
    """The places (from 1) of units whose signature holds, or is held by, that of the unit before."""
    signatures = F.transform(units, lambda u: F.regexp_replace(F.lower(u), r"[^\p{L}0-9]+", ""))
    n = F.size(signatures)

    def stitched(a: Column, b: Column) -> Column:
        return (F.length(a) >= least) & (F.length(b) >= least) & (a.contains(b) | b.contains(a))

    flags = F.when(n >= 2, F.zip_with(F.slice(signatures, 1, n - 1), F.slice(signatures, 2, n - 1), stitched)).otherwise(F.array().cast("array<boolean>"))
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i + 2)), lambda i: i.isNotNull())


def repeated_units(units: Column, least: int = 10) -> Column:
    """How many units repeat one seen before: their signature equals, holds or is held by a kept one.

    Units whose signature is short are left out, and one that repeats isn't kept itself.
    """
    signatures = F.filter(F.transform(units, lambda u: F.regexp_replace(F.lower(u), r"[^\p{L}0-9]+", "")), lambda s: F.length(s) >= least)
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"))
    return F.aggregate(
        signatures, start,
        lambda acc, s: F.when(F.exists(acc["seen"], lambda x: x.contains(s) | s.contains(x)), F.struct(acc["seen"].alias("seen"), (acc["n"] + 1).alias("n"))).otherwise(
            F.struct(F.array_append(acc["seen"], s).alias("seen"), acc["n"].alias("n"))
        ),
        lambda acc: acc["n"],
    )


def without_leading_boilerplate(text: Column, pattern: str) -> Column:
    """The text's stripped lines without the leading run that matches, blank lines collapsed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    plain = F.filter(F.transform(lines, lambda x, i: F.when((x != "") & ~x.rlike(pattern), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(plain) == 0, F.array().cast("array<string>")).otherwise(F.slice(lines, F.element_at(plain, 1) + 1, F.size(lines)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"\s+$", "")
