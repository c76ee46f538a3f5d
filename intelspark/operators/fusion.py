"""Opportunity lenses, next steps, explanations and the full prospect summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intelspark import rules
from intelspark.functions.text import distinct_non_blank
from intelspark.operators import scorecard as sc

# Texts of the recommendation layer.
ALIGNMENT_TEXT = {
    "direct_company_link": "Directly linked context reinforces the company evidence: ",
    "cross_border_exposure_link": "Cross-border context supports the overseas angle: ",
    "region_link": "Regional context supports timing and relevance: ",
    "industry_link": "Industry context supports the commercial case: ",
}
ALIGNMENT_OTHER = "Macro context provides background support: "
STEP_TEXT = {
    "cross_border": ("prepare RM outreach anchored on ", " and validate the cross-border evidence path"),
    "financing": ("prepare financing-focused outreach anchored on ", " and confirm timing through recent filings"),
    "acquisition": ("prepare acquisition outreach anchored on ", " and validate the supporting evidence"),
}
HEADLINE_TEXT = {
    "acquisition": " shows an acquisition-first opportunity",
    "financing": " shows a financing-led opportunity",
    "cross_border": " shows a cross-border opportunity",
}


def lens_scores() -> dict[str, Column]:
    """Products and score of each lens; scores round half to even into 0..100."""
    out = {}
    for key in rules.LENS_LABELS:
        out[f"{key}_products"] = F.expr(f"slice(filter(product_names, n -> n IN ({sc.sql_list(rules.LENS_PRODUCTS[key])})), 1, 3)")
    return out


def lens_points() -> dict[str, Column]:
    score = {
        "acquisition": "commercial_attractiveness_score + immediacy_score * 0.8D + least(evidence_confidence_score / 4D, 20D) - risk_penalty_score / 3D"
                       " + if(size(acquisition_products) > 0, 8, 0)",
        "financing": "product_fit_score * 1.2D + immediacy_score * 0.6D + financing_count * 6 + evidence_confidence_score / 5D"
                     " - risk_penalty_score / 3D + if(size(financing_products) > 0, 6, 0)",
        "cross_border": "border_count * 18 + if(size(cross_border_products) > 0, 18, 0) + immediacy_score * 0.5D"
                        " + evidence_confidence_score / 5D - risk_penalty_score / 4D",
    }
    clamped = {key: f"cast(greatest(0D, least(bround({text}, 0), 100D)) AS int)" for key, text in score.items()}
    clamped["cross_border"] = f"if(border_count = 0 AND size(cross_border_products) = 0, 0, {clamped['cross_border']})"
    return {f"{key}_lens": F.expr(text) for key, text in clamped.items()}


def primary_lens() -> Column:
    """Best lens; ties go to the later name."""
    a, f, c = F.col("acquisition_lens"), F.col("financing_lens"), F.col("cross_border_lens")
    return F.when((f >= a) & (f >= c), "financing").when(c >= a, "cross_border").otherwise("acquisition")


def lenses() -> Column:
    """The three lenses with their evidence and products, best first."""
    typed = lambda key: f"filter(opportunity_items, x -> x.signal_type IN ({sc.sql_list(rules.LENS_EVIDENCE_TYPES[key])}))"
    border = (f"filter(concat(opportunity_items, context_items), x -> x.signal_type IN ({sc.sql_list(rules.CROSS_BORDER_TYPES)}) "
              "OR x.linkage_type = 'cross_border_exposure_link')")
    evidence = {
        "acquisition": typed("acquisition"),
        "financing": f"if(financing_count > 0, {typed('financing')}, opportunity_items)",
        "cross_border": f"if(border_count > 0, {border}, context_items)",
    }
    rows = [
        f"named_struct('lens_score', {key}_lens, 'lens_key', '{key}', 'label', '{label}', "
        f"'supporting_evidence', {sc.evidence_sql(evidence[key])}, 'recommended_products', {key}_products)"
        for key, label in rules.LENS_LABELS.items()
    ]
    return F.expr(f"reverse(array_sort(array({', '.join(rows)})))")


def context_alignment() -> Column:
    prefix = None
    for kind, text in ALIGNMENT_TEXT.items():
        prefix = F.when(F.col("context_link") == kind, text) if prefix is None else prefix.when(F.col("context_link") == kind, text)
    return F.when(F.col("context_detail") != "", F.concat(prefix.otherwise(ALIGNMENT_OTHER), F.col("context_detail")))


def next_step() -> Column:
    """Risk first, then the leading lens with the top product."""
    top, lens = F.col("top_product"), F.col("primary_lens_key")
    expr = F.when(
        F.col("risk_count") > 0,
        F.when(F.col("any_high_risk"), "review high-severity risks before outreach and decide whether escalation is required")
        .otherwise("review latest risk factors alongside business signals before RM outreach"))
    for key, (before, after) in STEP_TEXT.items():
        expr = expr.when((lens == key) & top.isNotNull(), F.concat(F.lit(before), top, F.lit(after)))
    return expr.otherwise("review linked evidence and prepare RM follow-up")


def entry_angles() -> Column:
    top, lens = F.col("top_product"), F.col("primary_lens_key")
    lens_angle = (
        F.when((lens == "cross_border") & top.isNotNull(),
               F.concat(F.lit("Position the discussion around cross-border execution needs, starting with "), top, F.lit(".")))
        .when((lens == "financing") & top.isNotNull(),
              F.concat(F.lit("Anchor the conversation on near-term funding or liquidity planning, starting with "), top, F.lit(".")))
        .when(lens == "acquisition",
              F.lit("Open with the current growth window and frame the outreach around why this company merits attention now.")))
    return distinct_non_blank(F.array(
        F.concat(F.lit("Lead with the company event: "), F.col("primary_opportunity")), lens_angle, F.col("context_alignment"),
        F.concat(F.lit("Keep the pitch evidence-led and acknowledge the main caution point: "), F.col("key_risk"))), 4)


def lens_label() -> Column:
    expr = None
    for key, label in rules.LENS_LABELS.items():
        test = F.col("primary_lens_key") == key
        expr = F.when(test, label.lower()) if expr is None else expr.when(test, label.lower())
    return expr.otherwise("structured opportunity")


def why_now() -> Column:
    text = F.concat_ws(
        "; ", F.concat(F.lit("opportunity: "), F.col("primary_opportunity")), F.concat(F.lit("context: "), F.col("context_alignment")),
        F.concat(F.lit("risk watch: "), F.col("key_risk")))
    return F.nullif(text, F.lit(""))


def fusion_summary() -> Column:
    return F.concat_ws(
        "; ", F.concat(F.lit("Direct company evidence points to "), F.col("primary_opportunity")),
        F.concat(F.lit("the strongest current lens is "), lens_label()),
        F.concat(F.lit("with "), F.col("top_product"), F.lit(" as the leading product hypothesis")),
        F.lower("context_alignment"), F.concat(F.lit("while keeping in view that "), F.lower("key_risk")))


def decision_answers() -> Column:
    """Five or six question and answer pairs."""
    one = lambda c: F.array_compact(F.array(c))
    name = F.coalesce("display_name", "canonical_name", F.lit("This company"))

    def answer(key: str, question: str, text: Column, support: Column) -> Column:
        return F.struct(F.lit(key).alias("question_key"), F.lit(question).alias("question"), text.alias("answer"), support.alias("supporting_evidence"))

    return F.array_compact(F.array(
        answer("priority", rules.Q_PRIORITY,
               F.concat(name, F.lit(" is currently in "), F.col("status"), F.lit(" state, and the strongest business case points to "), lens_label(), F.lit(".")),
               one(F.col("primary_opportunity"))),
        answer("why_now", rules.Q_WHY_NOW,
               F.coalesce("why_now", F.lit("Current evidence is still limited, so immediate outreach is not yet strongly supported.")), one(F.col("why_now"))),
        answer("entry_angle", rules.Q_ENTRY, F.col("recommended_next_step"), one(F.col("top_product"))),
        answer("risk_watch", "What risks or uncertainties should be surfaced first?",
               F.coalesce("key_risk", F.lit("No major high-severity risk is visible yet, but evidence coverage is still incomplete.")), one(F.col("key_risk"))),
        F.when(F.col("context_alignment").isNotNull(),
               answer("context", "What external context supports this case?", F.col("context_alignment"), one(F.col("context_alignment")))),
        answer("confidence", "How reliable is this current view?",
               F.concat(F.lit("The current evidence confidence score is "), F.col("evidence_confidence_score").cast("string"),
                        F.lit("/100, so this should be treated as a strong starting point rather than a final conclusion.")),
               F.array().cast("array<string>"))))


def reasoning_steps() -> Column:
    """Company, context, product and risk steps, each only with evidence behind it."""
    keys = lambda *groups: f"transform(filter(decision_features, f -> f.feature_group IN ({sc.sql_list(groups)})), f -> f.feature_key)"
    links = lambda name: f"slice(array_distinct(transform({name}, x -> x.linkage_type)), 1, 3)"

    def step(present: str, key: str, summary: str, feature_keys: str, linkage_types: str, evidence: str) -> str:
        return (f"if(size({present}) > 0, named_struct('step_key', '{key}', 'summary', {summary}, 'feature_keys', {feature_keys}, "
                f"'linkage_types', {linkage_types}, 'evidence_items', {evidence}), null)")

    rows = (
        step("opportunity_items", "company_evidence", "'Direct company-linked activity creates the primary commercial hypothesis.'",
             f"concat({keys('commercial_attractiveness')}, {keys('immediacy')})", links("opportunity_items"), sc.evidence_sql("opportunity_items")),
        step("context_items", "context_linkage", "'External context is linked explicitly before it is allowed to support the company case.'",
             keys("evidence_confidence"), links("context_items"), sc.evidence_sql("context_items")),
        step("product_fit", "product_match", "concat('Current evidence most strongly aligns with ', top_product, ' as the first banking angle.')",
             keys("product_fit"), "cast(array() AS array<string>)", "get(product_fit, 0).supporting_signals"),
        step("risk_items", "risk_constraint", "'Risk evidence does not cancel the opportunity, but it should constrain outreach and framing.'",
             keys("risk_penalty"), links("risk_items"), sc.evidence_sql("risk_items")),
    )
    return F.expr(f"array_compact(array({', '.join(rows)}))")


def fused(state: DataFrame) -> DataFrame:
    """Recommendation columns on top of :func:`scorecard.company_state`."""
    out = state.withColumns({**lens_scores(), "context_alignment": context_alignment()}).withColumns(lens_points())
    out = out.withColumn("primary_lens_key", primary_lens())
    return out.withColumns({
        "recommended_next_step": next_step(), "why_now": why_now(), "fusion_summary": fusion_summary(),
        "recommended_entry_angles": entry_angles(), "state_summary": sc.state_summary(), "signal_highlights": sc.signal_highlights(),
    })


def why_prioritized() -> Column:
    answers = F.transform(F.slice("decision_answers", 1, 2), lambda a: a["answer"])
    return distinct_non_blank(F.concat(
        answers, F.slice("signal_highlights", 1, 2), F.array(F.col("fusion_summary"), F.col("why_now"), F.col("state_summary"))), 4)


def prospects(profile: DataFrame) -> DataFrame:
    """The full prospect record of every company: state, scores, recommendation and governance.

    Product, feature and lens records with their texts are columns too; Spark drops the ones a
    query does not select.
    """
    out = sc.with_features(sc.scored(fused(sc.company_state(profile)))).withColumn("opportunity_lenses", lenses())
    out = out.withColumns({"decision_answers": decision_answers(), "linkage_quality": sc.linkage_quality()})
    return out.withColumns({
        "prospect_id": F.concat(F.lit("prospect:"), F.col("company_id")),
        "governance_flags": sc.governance_flags(),
        "why_prioritized": why_prioritized(),
        "scorecard_version": F.lit(rules.SCORECARD_VERSION),
        "recommended_product_themes": F.col("product_names"),
    })


# ------------------------------------------------------------------ explanation, brief and review


def explanation() -> Column:
    """Deterministic explanation of a prospect."""
    name = F.coalesce("display_name", "canonical_name", F.lit("This company"))
    head = None
    for key, text in HEADLINE_TEXT.items():
        test = F.col("primary_lens_key") == key
        head = F.when(test, F.concat(name, F.lit(text))) if head is None else head.when(test, F.concat(name, F.lit(text)))
    return F.struct(
        F.lit("fallback").alias("status"), head.otherwise(F.concat(name, F.lit(" shows a structured opportunity"))).alias("headline"),
        F.col("why_now").alias("why_now"), F.col("fusion_summary").alias("lens_summary"), F.col("key_risk").alias("risk_note"),
        F.col("recommended_next_step").alias("action_note"), F.col("primary_lens_key").alias("primary_lens_key"),
        F.when(F.col("primary_lens_key") == "financing", F.col("financing_products")).when(
            F.col("primary_lens_key") == "cross_border", F.col("cross_border_products")).otherwise(F.col("acquisition_products")).alias("recommended_products"),
        F.col("priority_level").alias("prospect_priority"))


EXPLANATION_FIELDS = ("headline", "why_now", "lens_summary", "risk_note", "action_note", "primary_lens_key")


def merge_explanation(base: DataFrame, external: DataFrame) -> DataFrame:
    """Externally written explanation fields over the deterministic ones; blanks do not replace."""
    given = external.select("company_id", *[F.col(c).alias(f"x_{c}") for c in EXPLANATION_FIELDS])
    out = base.join(given, "company_id", "left")
    return out.select("company_id", *[F.coalesce(F.nullif(F.col(f"x_{c}"), F.lit("")), F.col(c)).alias(c) for c in EXPLANATION_FIELDS])


def brief(prospect: DataFrame) -> DataFrame:
    """One-paragraph brief with leading opportunities, risks and highlights."""
    name = F.coalesce("display_name", "canonical_name")
    summary = F.concat_ws(
        " ", F.concat(name, F.lit(" is currently "), F.col("priority_level"), F.lit(" priority with status "), F.col("status"), F.lit(".")),
        explanation()["headline"], F.concat(F.lit("Next step: "), F.col("recommended_next_step"), F.lit(".")))
    texts = lambda c: F.expr(f"filter(transform(slice({c}, 1, 3), x -> coalesce(nullif(x.detail, ''), x.title)), t -> t <> '')")
    return prospect.select(
        "prospect_id", "company_id", F.concat(name, F.lit(" brief")).alias("title"), summary.alias("summary"), "priority_level",
        "recommended_next_step", "recommended_product_themes", "recommended_entry_angles", texts("opportunity_items").alias("top_opportunities"),
        texts("risk_items").alias("top_risks"), F.slice("signal_highlights", 1, 3).alias("evidence_highlights"), "decision_answers")


def suggested_questions() -> Column:
    name = F.coalesce("display_name", "canonical_name")
    ask = lambda test, text: F.when(test, F.concat(F.lit(text), name, F.lit("?")))
    return F.array_compact(F.array(
        ask(F.col("opportunity_count") > 0, "What are the strongest opportunity signals for "),
        ask(F.col("risk_count") > 0, "What are the main risks to watch for "),
        ask(F.col("has_business_events"), "What recent business events matter most for "),
        ask(F.col("has_structured_metrics"), "Which metrics best support RM outreach for ")))


def evidence_bundle(prospect: DataFrame) -> DataFrame:
    flags = F.struct(*[F.col(f) for f in sc.FLAGS])
    return prospect.select("prospect_id", "company_id", flags.alias("coverage_flags"), "key_children",
                           F.struct("parsed_document_count", "metric_count", "risk_factor_count", "business_event_count").alias("evidence_summary"))


def copilot(prospect: DataFrame) -> DataFrame:
    """Brief, evidence and suggested questions side by side, on the prospect's own row."""
    asked = prospect.select("prospect_id", suggested_questions().alias("suggested_questions"))
    return brief(prospect).join(evidence_bundle(prospect).drop("company_id"), "prospect_id").join(asked, "prospect_id")


def linkage_reviews() -> Column:
    """Five leading items with the linkage a reviewer would suggest."""
    macro = f"(x.signal_type IN ('market', 'policy', 'macro') AND x.linkage_type NOT IN ('{sc.DIRECT}', 'macro_context_link'))"
    border = f"(x.signal_type IN ('cross_border', 'trade') AND x.linkage_type NOT IN ('{sc.DIRECT}', 'cross_border_exposure_link'))"
    pick = lambda a, b, other: f"CASE WHEN {macro} THEN {a} WHEN {border} THEN {b} ELSE {other} END"
    suggested = pick("'macro_context_link'", "'cross_border_exposure_link'", "x.linkage_type")
    return F.expr(f"""transform(slice(concat(opportunity_items, context_items, risk_items), 1, {rules.REVIEW_ITEMS}), (x, i) -> named_struct(
        'item_key', concat('signal_', i + 1), 'title', x.title, 'evidence_text', x.detail, 'current_linkage_type', x.linkage_type,
        'suggested_linkage_type', {suggested}, 'suggested_linkage_strength', {pick("'weak'", "'medium'", "x.linkage_strength")},
        'review_status', {pick("'challenge'", "'challenge'", "'confirm'")}, 'confidence', 0.6D,
        'should_affect_scoring', {suggested} <> 'macro_context_link',
        'reason', {pick("'This looks more like background context than strong company-specific evidence.'",
                        "'This evidence appears more relevant through overseas or trade exposure.'",
                        "'Current linkage is reasonable based on the available structured evidence.'")}))""")


def review(prospect: DataFrame) -> DataFrame:
    """Deterministic review: linkage checks, audit findings, extraction gaps and a summary."""
    step = F.col("recommended_next_step")
    findings = F.array_compact(F.array(
        F.when((F.col("priority_level") == "high") & (F.col("evidence_confidence_score") < 40), F.lit("high_priority_low_confidence")),
        F.when(F.col("top_product").isin(*rules.LENS_PRODUCTS["cross_border"]) & (F.col("border_count") == 0),
               F.lit("cross_border_product_overreach")),
        F.when((F.col("risk_penalty_score") >= 30) & (step != "") & ~step.contains("risk"), F.lit("risk_underemphasized"))))
    gaps = F.array_compact(F.array(*[F.when(~F.col(flag), F.lit(area)) for flag, area in (
        ("has_management_discussion", "management_discussion"), ("has_business_events", "business_events"),
        ("has_structured_metrics", "structured_metrics"), ("has_risk_factors", "risk_factors"))]))
    out = prospect.withColumns({"linkage_reviews": linkage_reviews(), "audit_findings": findings, "extraction_opportunities": gaps})
    name = F.coalesce("display_name", "canonical_name", F.lit("This company"))
    counted = lambda c, text: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(text)))
    summary = F.concat_ws(
        " ", F.concat(name, F.lit(" review generated in fallback mode.")), counted("audit_findings", " review finding(s) need attention."),
        counted("extraction_opportunities", " extraction gap(s) could improve evidence quality."))
    return out.select("company_id", "linkage_reviews", "audit_findings", "extraction_opportunities", summary.alias("review_summary"))


REVIEW_FIELDS = ("suggested_linkage_type", "review_status", "reason")


def merge_reviews(base: DataFrame, external: DataFrame) -> DataFrame:
    """External item reviews over the deterministic ones by item key, blanks filled from the base.

    A company without external rows keeps its deterministic reviews; one with external rows keeps
    only those.
    """
    old = base.select("company_id", F.explode_outer("linkage_reviews").alias("r")).filter(F.col("r").isNotNull()).select(
        "company_id", "r.item_key", *[F.col(f"r.{c}").alias(c) for c in REVIEW_FIELDS])
    new = external.filter(F.col("item_key") != "").select("company_id", "item_key", *[F.nullif(F.col(c), F.lit("")).alias(f"x_{c}") for c in REVIEW_FIELDS])
    merged = new.join(old, ["company_id", "item_key"], "left").select(
        "company_id", "item_key", F.coalesce("x_suggested_linkage_type", "suggested_linkage_type").alias("suggested_linkage_type"),
        F.coalesce("x_review_status", "review_status", F.lit("uncertain")).alias("review_status"),
        F.coalesce("x_reason", "reason", F.lit("LLM review did not provide a reason; use fallback context for manual review.")).alias("reason"))
    untouched = old.join(new.select("company_id").distinct(), "company_id", "left_anti")
    return merged.unionByName(untouched)
