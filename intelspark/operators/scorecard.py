"""Company state and scorecard.

Evidence is ranked and cut per company as rows, then one aggregation per company yields the
counts every score is made of plus short item arrays for the texts. Scores are arithmetic on
scalar columns; the only shuffles are the ones that gather the feeds by company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.text import distinct_non_blank, first_sentence, title_case
from intelspark.operators import lightweight as light
from intelspark.operators import serving as s

SIGNALS_KEPT, CHILDREN_KEPT = 10, 8
COUNTS = (
    "signal_count", "timeline_event_count", "generated_insight_count", "parsed_document_count", "management_discussion_count",
    "metric_count", "risk_factor_count", "business_event_count", "ocr_hit_count", "xbrl_hit_count",
)


# ------------------------------------------------------------------ linkage


def linkage_type(signal_company: Column, company: Column, kind: Column, entity: Column, region: Column) -> Column:
    """How a signal relates to a company."""
    name, has_entity = F.lower(F.coalesce(kind, F.lit(""))), F.coalesce(entity != "", F.lit(False))
    return (
        F.when(F.coalesce(signal_company == company, F.lit(False)) & (signal_company != ""), "direct_company_link")
        .when(name.isin("market", "policy", "macro"), "macro_context_link")
        .when(name.isin("cross_border", "trade") & has_entity, "cross_border_exposure_link")
        .when(has_entity & F.coalesce(region == "Hong Kong", F.lit(False)), "region_link")
        .otherwise("industry_link")
    )


def _taxonomy(kind: Column, index: int) -> Column:
    expr = None
    for row in rules.LINKAGE_TAXONOMY:
        expr = F.when(kind == row[0], F.lit(row[index])) if expr is None else expr.when(kind == row[0], F.lit(row[index]))
    return expr


def with_linkage(df: DataFrame, kind: Column) -> DataFrame:
    """Linkage type with its taxonomy attributes as columns."""
    return df.withColumn("linkage_type", kind).withColumns(
        {
            "linkage_label": _taxonomy(F.col("linkage_type"), 1),
            "linkage_strength": _taxonomy(F.col("linkage_type"), 2),
            "supports_company_scoring": _taxonomy(F.col("linkage_type"), 3),
            "context_only": _taxonomy(F.col("linkage_type"), 4),
        }
    )


# ------------------------------------------------------------------ counts per company


def company_counts(companies, signals, timeline, insights, documents) -> DataFrame:
    """Latest company row with the counts and newest times of every feed.

    The feeds are laid on top of each other and aggregated once, so all of them share one shuffle
    and one join instead of one each.
    """
    feeds = (
        (signals, "event_time", "signal_count", "last_signal_at"), (timeline, "event_time", "timeline_event_count", "last_event_at"),
        (insights, "generated_at", "generated_insight_count", "last_insight_at"))
    parts = [df.filter(F.trim("company_id") != "").select("company_id", F.lit(count).alias("feed"), F.col(time).alias("at")) for df, time, count, _ in feeds]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    activity = rows.groupBy("company_id").agg(
        *[F.count_if(F.col("feed") == count).alias(count) for _, _, count, _ in feeds],
        *[F.max(F.when(F.col("feed") == count, F.col("at"))).alias(last) for _, _, count, last in feeds])
    out = s.latest_companies(companies)
    for part in (activity, s.evidence_summary(documents), s.ordered_types(signals)):
        out = out.join(part, "company_id", "left")
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in COUNTS}
    flags = {flag: F.col(count) > 0 for flag, count in FLAGS.items()}
    return (
        out.withColumns({**counts, "signal_types": F.coalesce("signal_types", F.array())})
        .withColumn("activity_at", F.greatest("last_signal_at", "last_event_at", "last_insight_at", "last_parsed_at"))
        .withColumns(flags)
    )


# ------------------------------------------------------------------ evidence items

DIRECT = "direct_company_link"
ITEM_LIMITS = {"opportunity": 4, "risk": 4, "context": 5}
ITEM_FIELDS = ("title", "detail", "source_type", "source", "signal_type", "severity", "confidence",
               "linkage_type", "linkage_strength", "supports_company_scoring", "context_only")


def item_rows(signals, documents, children) -> DataFrame:
    """Candidate evidence of the three lists as rows with their order, a few dozen per company at most."""
    recent = s.top_n(signals, "company_id", SIGNALS_KEPT, F.desc_nulls_last("event_time"), F.desc("id"))
    # Signals gathered by company are the company's own, whatever their type.
    recent = recent.withColumn("link", linkage_type(F.col("company_id"), F.col("company_id"), F.col("signal_type"), F.col("entity"), F.lit(None)))
    text = F.coalesce(F.nullif(F.col("signal_text"), F.lit("")), F.col("indicator"))
    def use_as(kinds, name: str, suffix: str, source_type: str, level: Column) -> Column:
        made = F.struct(F.lit(name).alias("list"), F.lit(suffix).alias("suffix"), F.lit(source_type).alias("st"), level.alias("sev"))
        return F.when(F.col("signal_type").isin(*kinds), made)

    use = F.array_compact(F.array(
        use_as(rules.OPPORTUNITY_TYPES, "opportunity", " signal", "trigger_signal", F.lit(None).cast("string")),
        use_as(rules.RISK_TYPES, "risk", " signal", "trigger_signal", F.col("signal_level")),
        use_as(rules.CONTEXT_TYPES, "context", " context", "market_signal", F.col("signal_level"))))
    from_signals = recent.withColumn("u", F.explode_outer(use)).filter(F.col("u").isNotNull()).select(
        "company_id", F.col("u.list").alias("list"), F.col("rank").alias("ord"), F.concat(title_case("signal_type"), F.col("u.suffix")).alias("title"),
        text.alias("text"), F.col("u.st").alias("source_type"), "source", "signal_type", F.col("u.sev").alias("severity"),
        F.col("signal_score").cast("double").alias("confidence"), F.col("link").alias("linkage_type"))

    kids = s.top_n(children.filter(F.col("kind").isin("risk", "event")), ["company_id", "kind"], CHILDREN_KEPT, *s.child_order())
    is_event = F.col("kind") == "event"
    kind = F.when(is_event, F.col("event_type")).otherwise(F.col("category"))
    from_children = kids.select(
        "company_id", F.when(is_event, "opportunity").otherwise("risk").alias("list"), (F.col("rank") + 100).alias("ord"),
        F.concat(title_case(kind), F.when(is_event, " event").otherwise(" risk")).alias("title"), F.col("summary").alias("text"),
        F.when(is_event, "parsed_business_event").otherwise("parsed_risk_factor").alias("source_type"), F.lit("parsed_documents").alias("source"),
        kind.alias("signal_type"), F.when(~is_event, F.col("severity")).alias("severity"), F.col("confidence").cast("double").alias("confidence"),
        F.lit(DIRECT).alias("linkage_type"))

    newest = s.latest_by(documents, "company_id", F.desc_nulls_last("parsed_at"), F.desc("id"))
    both = F.array(
        F.struct(F.lit("opportunity").alias("list"), F.lit("Management discussion takeaway").alias("title"), F.lit("management_discussion").alias("k")),
        F.struct(F.lit("context").alias("list"), F.lit("Company context from latest report").alias("title"), F.lit("company_context").alias("k")))
    from_documents = newest.filter(F.trim("management_discussion_summary") != "").select("*", F.explode(both).alias("u")).select(
        "company_id", "u.list", F.lit(1000).alias("ord"), "u.title", F.col("management_discussion_summary").alias("text"),
        F.lit("parsed_document").alias("source_type"), "source", F.col("u.k").alias("signal_type"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("double").alias("confidence"), F.lit(DIRECT).alias("linkage_type"))
    return from_signals.unionByName(from_children).unionByName(from_documents).withColumn("detail", first_sentence("text")).drop("text")


def linked_items(rows: DataFrame) -> DataFrame:
    """Distinct items per list, first occurrence kept, cut to the list's length, with a position.

    One exchange by company serves both windows and the aggregation that follows.
    """
    rows = with_linkage(rows, F.col("linkage_type")).drop("linkage_label").repartition("company_id")
    once = s.latest_by(rows, ["company_id", "list", "title", "detail", "source_type", "linkage_type", "linkage_strength"], F.asc("ord"))
    ranked = once.withColumn("pos", F.row_number().over(W.partitionBy("company_id", "list").orderBy("ord")))
    limit = F.when(F.col("list") == "context", ITEM_LIMITS["context"]).otherwise(ITEM_LIMITS["opportunity"])
    kept = ranked.filter(F.col("pos") <= max(ITEM_LIMITS.values())).filter(F.col("pos") <= limit)
    return kept.withColumn("item_text", F.coalesce(F.nullif(F.col("detail"), F.lit("")), F.col("title"))).drop("ord")


def _catalog():
    return sorted(rules.PRODUCTS, key=lambda p: (-p[1], p[0]))


def item_measures(items: DataFrame) -> DataFrame:
    """Per company: the counts all scores are made of, and the three short item arrays."""
    lst, kind, link = F.col("list"), F.col("signal_type"), F.col("linkage_type")
    opp, risk, ctx = lst == "opportunity", lst == "risk", lst == "context"
    border = kind.isin(*rules.CROSS_BORDER_TYPES) | (link == "cross_border_exposure_link")

    level, penalty = F.lower(F.coalesce("severity", F.lit(""))), None
    for name, points in rules.SEVERITY_PENALTY.items():
        penalty = F.when(level == name, points) if penalty is None else penalty.when(level == name, points)

    def triggers(kinds, links, needs_risk):
        return risk if needs_risk else (kind.isin(*kinds) | link.isin(*links))

    packed = F.struct("list", "pos", *ITEM_FIELDS)
    out = items.groupBy("company_id").agg(
        F.count_if(opp).alias("opportunity_count"), F.count_if(risk).alias("risk_count"), F.count_if(ctx).alias("context_count"),
        F.count_if(opp & kind.isin(*rules.GROWTH_LIKE_TYPES)).alias("growth_count"),
        F.count_if((opp | ctx) & F.col("supports_company_scoring")).alias("scoreable_count"),
        F.count_if((opp | ctx) & border).alias("border_count"),
        F.count_if(opp & kind.isin(*rules.LENS_EVIDENCE_TYPES["financing"])).alias("financing_count"),
        F.count_if(link == DIRECT).alias("direct_count"), F.count_if(F.col("linkage_strength") == "strong").alias("strong_count"),
        F.count_if("supports_company_scoring").alias("usable_count"), F.count_if("context_only").alias("context_only_count"),
        F.count(F.lit(1)).alias("linked_count"),
        F.max(F.when(risk, penalty.otherwise(rules.SEVERITY_PENALTY_OTHER))).alias("risk_severity_points"),
        F.max(F.coalesce(risk & (F.col("severity") == "high"), F.lit(False))).alias("any_high_risk"),
        F.array_sort(F.collect_set(F.nullif(F.col("source"), F.lit("")))).alias("item_sources"),
        F.max(F.when(opp & (F.col("pos") == 1), F.col("item_text"))).alias("primary_opportunity"),
        F.max(F.when(risk & (F.col("pos") == 1), F.col("item_text"))).alias("key_risk"),
        F.max(F.when(ctx & (F.col("pos") == 1), F.col("detail"))).alias("context_detail"),
        F.max(F.when(ctx & (F.col("pos") == 1), link)).alias("context_link"),
        *[F.max(F.coalesce(triggers(*p[2:]), F.lit(False))).alias(f"fits_{i}") for i, p in enumerate(_catalog())],
        F.array_sort(F.collect_list(packed)).alias("_items"),
    )
    lists = {f"{name}_items": F.expr(f"transform(filter(_items, x -> x.list = '{name}'), x -> named_struct({', '.join(repr(c) + ', x.' + c for c in ITEM_FIELDS)}))") for name in ITEM_LIMITS}
    return out.withColumns(lists).drop("_items")


def child_measures(children: DataFrame) -> DataFrame:
    """Leading extracted risks and events of each company: how many, their titles and first event type."""
    kids = s.top_n(children.filter(F.col("kind").isin("risk", "event")), ["company_id", "kind"], CHILDREN_KEPT, *s.child_order())
    event = F.col("kind") == "event"
    packed = F.array_sort(F.collect_list(F.struct("rank", "kind", "title", "summary", "severity", "event_type", "category")))
    return kids.groupBy("company_id").agg(
        F.count_if(event).alias("key_event_count"),
        F.max(F.when(event & (F.col("rank") == 1), F.col("event_type"))).alias("first_event_type"), packed.alias("key_children"))


def profile(companies, signals, timeline, insights, documents, children) -> DataFrame:
    """Everything the scorecard needs about all companies, one row each."""
    measures = item_measures(linked_items(item_rows(signals, documents, children)))
    out = company_counts(companies, signals, timeline, insights, documents)
    out = out.join(measures, "company_id", "left").join(child_measures(children), "company_id", "left")
    numbers = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in measures.columns + ["key_event_count"] if c.endswith("_count")}
    truths = {c: F.coalesce(c, F.lit(False)) for c in measures.columns if c.startswith("fits_") or c == "any_high_risk"}
    lists = {c: F.coalesce(c, F.array()) for c in ("item_sources", "key_children", *[f"{n}_items" for n in ITEM_LIMITS])}
    return out.withColumns({**numbers, **truths, **lists})


def sql_list(values) -> str:
    """Strings as a SQL literal list."""
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def evidence_sql(items: str, limit: int = 3) -> str:
    """SQL for the distinct evidence texts of an item array."""
    return f"slice(array_distinct(filter(transform({items}, x -> coalesce(nullif(x.detail, ''), x.title)), t -> t <> '')), 1, {limit})"


# ------------------------------------------------------------------ flags and tags

FLAGS = {
    "has_recent_signals": "signal_count",
    "has_recent_timeline": "timeline_event_count",
    "has_generated_insights": "generated_insight_count",
    "has_parsed_reports": "parsed_document_count",
    "has_management_discussion": "management_discussion_count",
    "has_structured_metrics": "metric_count",
    "has_risk_factors": "risk_factor_count",
    "has_business_events": "business_event_count",
    "has_ocr_support": "ocr_hit_count",
    "has_xbrl_support": "xbrl_hit_count",
}


def focus_tags() -> Column:
    tag = lambda test, name: F.when(test, F.lit(name))
    rest = F.array(
        F.col("first_event_type"), tag(F.col("management_discussion_count") > 0, "management_discussion"),
        tag(F.col("xbrl_hit_count") > 0, "xbrl"), tag(F.col("risk_factor_count") > 0, "risk_review"))
    return distinct_non_blank(F.concat(F.slice("signal_types", 1, 3), rest))


# ------------------------------------------------------------------ product fit


def product_names() -> Column:
    """The four best fitting products, from the trigger flags alone."""
    return F.slice(F.array_compact(F.array(*[F.when(F.col(f"fits_{i}"), p[0]) for i, p in enumerate(_catalog())])), 1, 4)


def product_fit() -> Column:
    """The same products with fit score and up to two supporting texts."""

    def made(i, name, fit, kinds, links, needs_risk):
        if needs_risk:
            support = "slice(risk_items, 1, 3)"
        else:
            tests = [f"x.{c} IN ({sql_list(v)})" for c, v in (("signal_type", kinds), ("linkage_type", links)) if v]
            support = f"slice(filter(concat(opportunity_items, context_items, risk_items), x -> {' OR '.join(tests)}), 1, 3)"
        return f"if(fits_{i}, named_struct('product_name', '{name}', 'fit_score', {fit}, 'supporting_signals', {evidence_sql(support, 2)}), null)"

    return F.expr(f"slice(array_compact(array({', '.join(made(i, *p) for i, p in enumerate(_catalog()))})), 1, 4)")


# ------------------------------------------------------------------ features

# Why each feature counts.
RATIONALE = {
    "growth_activity_intensity": "Company-linked growth or expansion evidence suggests commercial upside.",
    "market_visibility": "More linked signals increase the company’s observable market activity.",
    "business_event_specificity": "Structured company events increase commercial specificity and outreach relevance.",
    "recent_activity_momentum": "Recent company-linked activity suggests there is a timely reason to review now.",
    "management_update_availability": "Management commentary provides current strategic context for banker outreach.",
    "cross_border_operating_exposure": "Cross-border or trade-linked evidence suggests transaction banking and corridor relevance.",
    "linked_risk_severity": "Linked risk evidence should reduce or constrain outreach priority.",
    "structured_risk_coverage": "Structured risk factor coverage indicates the recommendation should include explicit caution.",
    "direct_evidence_ratio": "A higher share of direct company-linked evidence increases trust in the recommendation.",
    "structured_evidence_coverage": "Broader structured extraction coverage makes the company view more reliable.",
    "source_diversity": "Multiple independent sources reduce single-source bias in the recommendation.",
}
GROUP_OF = {key: group for key, _, group, _, _ in rules.FEATURES}
STRUCTURED_FLAGS = ("has_parsed_reports", "has_management_discussion", "has_structured_metrics", "has_business_events", "has_risk_factors")
MOMENTUM = "(signal_count + timeline_event_count)"
COVERED = "(" + " + ".join(f"cast({flag} AS int)" for flag in STRUCTURED_FLAGS) + ")"
DIRECT_SHARE = "(direct_count / cast(nullif(linked_count, 0) AS double))"

# key: (present when, value, points before the cap), all over scalar columns of the profile
FEATURE_RULES = {
    "growth_activity_intensity": ("growth_count > 0", "growth_count", "growth_count * 12"),
    "market_visibility": ("signal_count > 0", "scoreable_count", "scoreable_count * 4"),
    "business_event_specificity": ("key_event_count > 0", "key_event_count", "key_event_count * 10"),
    "recent_activity_momentum": (f"{MOMENTUM} > 0", MOMENTUM, f"least({MOMENTUM} * 4, 1000)"),
    "management_update_availability": ("has_management_discussion", "1", "10"),
    "top_product_fit_strength": ("top_fit > 0", "top_fit", "greatest(cast(top_fit / 10 AS int), 0)"),
    "cross_border_operating_exposure": ("border_count > 0", "border_count", "border_count * 6"),
    "linked_risk_severity": ("risk_count > 0", "risk_count", "risk_severity_points"),
    "structured_risk_coverage": ("has_risk_factors", "risk_factor_count", "10"),
    "direct_evidence_ratio": (
        "linked_count > 0", f"bround({DIRECT_SHARE}, 2)", f"CASE WHEN {DIRECT_SHARE} >= 0.75D THEN 30 WHEN {DIRECT_SHARE} >= 0.5D THEN 22 ELSE 12 END"),
    "structured_evidence_coverage": (f"{COVERED} > 0", COVERED, f"{COVERED} * 5"),
    "source_diversity": ("size(item_sources) > 0", "size(item_sources)", "size(item_sources) * 5"),
}


def feature_points() -> dict[str, Column]:
    """Capped points per feature, 0 when the company does not have it."""
    return {
        f"points_{key}": F.expr(f"if({present}, least(cast({points} AS int), {rules.FEATURE_CAPS[key]}), 0)")
        for key, (present, _, points) in FEATURE_RULES.items()
    }


def features() -> Column:
    """The features a company has in fixed order, with value, points, rationale and evidence."""
    typed = lambda items, kinds: f"filter({items}, x -> x.signal_type IN ({sql_list(kinds)}))"
    titles = lambda kind: f"slice(array_distinct(filter(transform(filter(key_children, x -> x.kind = '{kind}'), x -> x.title), t -> t <> '')), 1, 3)"
    both = "concat(opportunity_items, context_items)"
    lead = evidence_sql("if(opportunity_count > 0, opportunity_items, context_items)")
    names = sql_list(("parsed report", "management discussion", "structured metrics", "business events", "risk factors"))
    evidence = {
        "growth_activity_intensity": evidence_sql(typed("opportunity_items", rules.GROWTH_LIKE_TYPES)),
        "market_visibility": lead,
        "business_event_specificity": titles("event"),
        "recent_activity_momentum": lead,
        "management_update_availability": evidence_sql(
            f"filter({both}, x -> x.signal_type = 'management_discussion' OR (x.signal_type = 'company_context' "
            "AND NOT exists(opportunity_items, y -> y.signal_type = 'management_discussion')))"),
        "top_product_fit_strength": "get(product_fit, 0).supporting_signals",
        "cross_border_operating_exposure": evidence_sql(
            f"filter({both}, x -> x.signal_type IN ({sql_list(rules.CROSS_BORDER_TYPES)}) OR x.linkage_type = 'cross_border_exposure_link')"),
        "linked_risk_severity": evidence_sql("risk_items"),
        "structured_risk_coverage": titles("risk"),
        "direct_evidence_ratio": evidence_sql("concat(opportunity_items, risk_items, context_items)"),
        "structured_evidence_coverage": f"slice(array({names}), 1, {COVERED})",
        "source_diversity": "slice(item_sources, 1, 3)",
    }

    def made(key: str) -> str:
        present, value, _ = FEATURE_RULES[key]
        why = f"'{RATIONALE[key]}'" if key in RATIONALE else "concat('Top product fit is ', top_product, ', indicating a plausible first banking angle.')"
        return (f"if({present}, named_struct('feature_key', '{key}', 'feature_group', '{GROUP_OF[key]}', 'value_num', cast({value} AS double), "
                f"'score_contribution', points_{key}, 'rationale', {why}, 'evidence_items', {evidence[key]}), null)")

    return F.expr(f"array_compact(array({', '.join(made(key) for key in FEATURE_RULES)}))")


def group_scores() -> dict[str, Column]:
    """Capped sum of the points of each feature group."""
    names = {"risk_penalty": "risk_penalty_score", "evidence_confidence": "evidence_confidence_score"}
    out = {}
    for group, cap in rules.GROUP_CAPS.items():
        total = " + ".join(f"points_{key}" for key in FEATURE_RULES if GROUP_OF[key] == group)
        out[names.get(group, f"{group}_score")] = F.expr(f"least({total}, {cap})")
    return out


def capped_groups(rows: DataFrame, key: str, group: str, points: str) -> DataFrame:
    """The same capped sums over features in long form."""
    sums = rows.groupBy(key, group).agg(F.sum(points).cast("int").alias("score"))
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in rules.GROUP_CAPS.items() for x in pair]), F.col(group))
    return sums.withColumn("score", F.least("score", cap))


def feature_rows(state: DataFrame) -> DataFrame:
    """Features in long form, with the dictionary's label, question and cap attached."""
    spark = state.sparkSession
    names = spark.createDataFrame([f for f in rules.FEATURES], "feature_key string, feature_label string, _g string, business_question string, max_score_contribution int")
    # The outer form adds no filter on the array, which would be copied below every step that built it.
    long = state.select("company_id", F.posexplode_outer("decision_features").alias("position", "f")).filter(F.col("f").isNotNull())
    long = long.select("company_id", "position", "f.*")
    # Twelve fixed rows: a bounded dimension.
    return long.join(F.broadcast(names.drop("_g")), "feature_key", "left")


def status() -> Column:
    active = F.col("has_recent_signals") | F.col("has_parsed_reports") | F.col("has_recent_timeline")
    actionable = F.col("has_generated_insights") | (F.col("opportunity_count") >= 2) | (F.col("risk_count") >= 2)
    return F.when(actionable, "actionable").when(active, "active").otherwise("monitor")


def company_state(profile: DataFrame) -> DataFrame:
    """Tags, products, points, group scores and status.

    Scores come from scalar columns only, so a filter on a score stays a short predicate and the
    evidence texts are built for the rows that survive it.
    """
    out = profile.withColumns({"focus_tags": focus_tags(), "product_names": product_names(), "status": status()})
    top_fit = F.coalesce(*[F.when(F.col(f"fits_{i}"), p[1]) for i, p in enumerate(_catalog())])
    out = out.withColumns({"top_product": F.get("product_names", 0), "top_fit": top_fit})
    return out.withColumns(feature_points()).withColumns(group_scores())


def with_features(state: DataFrame) -> DataFrame:
    """Product and feature records with their evidence texts."""
    return state.withColumn("product_fit", product_fit()).withColumn("decision_features", features())


def scored(state: DataFrame) -> DataFrame:
    """Opportunity, risk and priority scores and the priority level."""
    out = state.withColumns({
        "opportunity_score": F.least(F.col("commercial_attractiveness_score") + F.col("immediacy_score") + F.col("product_fit_score"), F.lit(100)),
        "risk_score": F.least("risk_penalty_score", F.lit(100)),
    })
    out = out.withColumn("priority_score", light.priority_score(F.col("opportunity_score"), F.col("evidence_confidence_score"), F.col("risk_score")))
    return out.withColumn("priority_level", light.priority_level(F.col("priority_score"), F.col("status")))


def score_components(kind: str) -> Column:
    groups = ("commercial_attractiveness", "immediacy", "product_fit") if kind == "opportunity" else ("risk_penalty",)
    return F.transform(
        F.filter("decision_features", lambda x: x["feature_group"].isin(*groups)),
        lambda x: F.struct(x["feature_key"].alias("name"), x["feature_group"].alias("category"), x["score_contribution"].alias("points")))


def priority_components() -> Column:
    """The weighted parts of the priority score, plus a marker when the status gate is open."""
    opp, conf, risk = F.col("opportunity_score"), F.col("evidence_confidence_score"), F.col("risk_score")
    parts = light.priority_parts(opp, conf, risk)
    names = ("opportunity_weighted", "evidence_confidence_weighted", "risk_buffer")
    rows = [F.struct(F.lit(n).alias("name"), p.alias("points")) for n, p in zip(names, parts)]
    gate = F.when(F.col("status") == "actionable", F.struct(F.lit("actionable_status_gate").alias("name"), F.lit(0).alias("points")))
    return F.array_compact(F.array(*rows, gate))


# ------------------------------------------------------------------ linkage quality and governance


def linkage_quality() -> Column:
    """Counts and shares over the linked items of a company."""
    share = lambda count: F.expr(f"if(linked_count > 0, bround({count} / cast(linked_count AS double), 2), 0D)")
    return F.struct(
        F.col("linked_count").alias("linked_evidence_count"), F.col("usable_count").alias("scoreable_evidence_count"),
        F.col("direct_count").alias("direct_evidence_count"), F.col("strong_count").alias("strong_linkage_count"), "context_only_count",
        share("direct_count").alias("direct_evidence_ratio"), share("usable_count").alias("scoreable_evidence_ratio"))


def linkage_type_counts(items: DataFrame) -> DataFrame:
    """Items per linkage type and company, in long form."""
    return items.groupBy("company_id", F.coalesce("linkage_type", F.lit("unknown")).alias("linkage_type")).agg(F.count(F.lit(1)).alias("count"))


def governance_flags() -> Column:
    """Keys of the governance checks a scored company fails; needs linkage_quality and the next step."""
    q = F.col("linkage_quality")
    tests = (
        (F.col("priority_level") == "high") & (F.col("evidence_confidence_score") < 50),
        (F.col("priority_score") >= 50) & (q["direct_evidence_ratio"] < 0.5),
        (F.col("opportunity_score") > 60) & (q["context_only_count"] > q["direct_evidence_count"]),
        (F.col("risk_score") >= 30) & (F.col("recommended_next_step") != "") & ~F.col("recommended_next_step").contains("risk"),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in zip(rules.GOVERNANCE_FLAGS, tests)]))


# ------------------------------------------------------------------ summary texts


def state_summary() -> Column:
    parts = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
        for c, text in (("signal_count", " recent signals"), ("parsed_document_count", " parsed documents"), ("generated_insight_count", " generated insights"))]))
    prefix = (
        F.when(F.col("status") == "actionable", "Company has enough linked evidence for immediate RM follow-up")
        .when(F.col("status") == "active", "Company has recent linked evidence worth review")
        .otherwise("Company currently has limited linked evidence"))
    return F.when(F.size(parts) > 0, F.concat(prefix, F.lit(": "), F.array_join(parts, ", "), F.lit("."))).otherwise(prefix)


def signal_highlights() -> Column:
    n = lambda c: F.col(c).cast("string")
    lead = F.when(
        F.col("signal_count") > 0,
        F.when(F.size("signal_types") > 0,
               F.concat(n("signal_count"), F.lit(" recent signals linked, led by "), F.array_join(F.slice("signal_types", 1, 3), ", ")))
        .otherwise(F.concat(n("signal_count"), F.lit(" recent signals linked to the company"))))
    docs = F.when(F.col("has_parsed_reports"), F.concat_ws(
        ", ", F.concat(n("parsed_document_count"), F.lit(" parsed documents")),
        F.when(F.col("has_management_discussion"), F.concat(n("management_discussion_count"), F.lit(" with management discussion"))),
        F.when(F.col("has_ocr_support"), F.lit("OCR support hit")), F.when(F.col("has_xbrl_support"), F.lit("XBRL support hit"))))
    found = F.concat_ws(
        ", ", *[F.when(F.col(flag), F.concat(n(c), F.lit(text))) for flag, c, text in (
            ("has_structured_metrics", "metric_count", " metrics"), ("has_risk_factors", "risk_factor_count", " risk factors"),
            ("has_business_events", "business_event_count", " business events"))])
    return F.array_compact(F.array(lead, docs, F.when(found != "", F.concat(F.lit("Structured extraction captured "), found))))
