"""Session reports: first turns, the outcome ladder, candidate paths, classifier mapping, identity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What a classified outcome says about retrieval, candidate set and recommendation.
OUTCOMES = {
    "absent": ("not_retrieved", "absent", "not_recommended"),
    "mentioned": ("retrieved", "absent", "not_recommended"),
    "shortlisted": ("retrieved", "included", "not_recommended"),
    "recommended": ("retrieved", "included", "recommended"),
    "final_choice": ("retrieved", "included", "final_choice"),
}
#: The bound is this expression and not 0.2: in doubles they differ.
UNIDENTIFIED = 1 - 0.8


def first_turns(turns: DataFrame, key: str, ordinal: str, flags: dict[str, Column]) -> DataFrame:
    """The first ordinal at which each flag holds, or null, and the number of turns."""
    return turns.groupBy(key).agg(*[F.min(F.when(c, F.col(ordinal))).alias(f"first_{n}") for n, c in flags.items()], F.count("*").alias("n_turns"))


def outcome(final: Column, recommended: Column, candidate: Column, retrieved: Column, interrupted: Column) -> Column:
    """The furthest step a session reached; an interruption or an unresolved turn makes it inconclusive."""
    return (
        F.when(interrupted, "inconclusive").when(final.isNotNull(), "final_choice").when(recommended.isNotNull(), "recommended").when(candidate.isNotNull(), "candidate").when(retrieved.isNotNull(), "retrieved").otherwise("absent")
    )


def classified(choice: Column, confidence: Column, named: Column, shape: Column) -> Column:
    """The observation of one classified answer: a struct of fallback_reason, or the four observations.

    choice: an outcome; confidence and named (whether the target is identified): probabilities; shape: the answer's.
    Below 0.7 nothing is said, unknown is never absent, and outcome and identity must agree at 0.8 and its complement.
    """
    known = choice.isin(*OUTCOMES)
    present = choice.isin("mentioned", "shortlisted", "recommended", "final_choice")
    reason = (
        F.when(~F.coalesce(known | (choice == "not_observed"), F.lit(False)), "unknown_option").when(F.coalesce(confidence, F.lit(0.0)) < 0.7, "low_confidence").when(choice == "not_observed", "not_observed")
        .when(present & (named < 0.8) | (choice == "absent") & ~(named < F.lit(UNIDENTIFIED)), "inconsistent_identity")
    )
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[i])]), choice)
    compares = shape.isin("comparison", "decision")
    included = choice.isin("shortlisted", "recommended", "final_choice")
    comparison = F.when(~compares, F.when(included, "not_compared").otherwise("not_observed")).when(included, "retained").otherwise("not_compared")
    fine = reason.isNull()
    return F.struct(reason.alias("fallback_reason"), *[F.when(fine, c).alias(n) for n, c in (("retrievability", pick(0)), ("candidate_set", pick(1)), ("comparison", comparison), ("recommendation", pick(2)))])


def candidate_path(turns: DataFrame, key: str, ordinal: str, present: Column, action: Column) -> DataFrame:
    """Turns with `path`: seen, absent, open (exploring or verifying, so it may come back) or closed once it was absent before."""
    w = W.partitionBy(key).orderBy(ordinal)
    gone = F.coalesce(F.max((~present).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    return turns.withColumn("path", F.when(present, "seen").when(action.isin("explore", "verify"), "open").when(gone, "closed").otherwise("absent"))


def stage(action: Column) -> Column:
    """The stage of the next turn by what was decided."""
    return F.when(action == "explore", "discovery").when(action == "compare", "comparison").when(action == "verify", "caveat_check").otherwise("refinement")


def replay_action(status: Column) -> Column:
    return F.when(status.isNull() | (status == "reserved"), "execute").when(status == "completed", "advance").when(status == "running", "reconcile").otherwise("ignore")


def publisher_label(title: Column, host: Column, redirect_hosts: tuple[str, ...] = ("vertexaisearch.cloud.google.com",)) -> Column:
    """A title that looks like a domain, else the host, except that of a search redirect; failing these the title or host as it is."""
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    return F.when(title.rlike(r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"), bare(title)).when(~host.isin(*redirect_hosts), bare(host)).otherwise(F.coalesce(title, host, F.lit("Source")))


def target_match(host: Column, title: Column, answer: Column, domains: list[str], needles: list[str]) -> Column:
    """Whether a source is about the target, as struct(named, on_domain). A name is sought in the title and the whole answer; short needles say nothing."""
    text = F.lower(F.concat_ws(" ", title, answer))
    long = [n.lower() for n in needles if len(n) >= 4]
    named, on = F.lit(False), F.lit(False)
    for n in long:
        named |= F.contains(text, F.lit(n))
    for d in domains:
        on |= (host == d) | host.endswith("." + d)
    return F.struct(F.coalesce(named, F.lit(False)).alias("named"), F.coalesce(on, F.lit(False)).alias("on_domain"))


def novelty(rows: DataFrame, key: str, order: list[str], signature: str) -> DataFrame:
    """rows with `fresh` (its signature was not seen before in its key) and `idle`, the number of rows since one was."""
    first = rows.groupBy(key, signature).agg(F.min(F.struct(*order)).alias("_first"))
    out = rows.join(first, [key, signature]).withColumn("fresh", F.col("_first") == F.struct(*order)).drop("_first")
    w = W.partitionBy(key).orderBy(*order)
    island = F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("_island", island).withColumn("idle", F.row_number().over(W.partitionBy(key, "_island").orderBy(*order)) - 1).drop("_island")


def integrity_issues(assessment: DataFrame, needs: DataFrame, turns: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims of an assessment that nothing supports: (session, candidate, need_id, issue).

    assessment: session, candidate, need_id, status, quote, turn, source_ids; needs: session, need_id; turns: session,
    turn, text; sources: session, source_id.
    """
    known = sources.groupBy("session").agg(F.collect_set("source_id").alias("known"))
    out = assessment.join(needs.select("session", "need_id", F.lit(True).alias("need_known")), ["session", "need_id"], "left").join(turns, ["session", "turn"], "left").join(known, "session", "left")
    unknown = F.array_except("source_ids", F.coalesce("known", F.array().cast("array<string>")))
    issue = (
        F.when(F.col("need_known").isNull(), "UNKNOWN_NEED").when(F.col("quote").isNotNull() & ~F.coalesce(F.contains("text", "quote"), F.lit(False)), "QUOTE_NOT_IN_TURN")
        .when(F.size(unknown) > 0, "UNKNOWN_SOURCE").when((F.col("status") == "supported") & F.col("quote").isNull(), "UNSUPPORTED_PROMOTION").when((F.col("status") == "cited") & (F.size("source_ids") == 0), "CITED_WITHOUT_SOURCE")
    )
    return out.select("session", "candidate", "need_id", issue.alias("issue")).where("issue IS NOT NULL")


def recovered(assessment: DataFrame, issues: DataFrame) -> DataFrame:
    """Claims with an issue fall back to unknown; none is ever raised."""
    bad = issues.select("session", "candidate", "need_id", F.lit(True).alias("_bad")).distinct()
    return assessment.join(bad, ["session", "candidate", "need_id"], "left").withColumn("status", F.when(F.col("_bad"), "unknown").otherwise(F.col("status"))).drop("_bad")


def technical_summary(status: Column, codes: Column) -> Column:
    bad = F.exists(codes, lambda c: c.isin("PAGE_NOINDEX", "CRAWLER_BLOCKED", "PASSWORD_PAGE", "CHALLENGE_PAGE"))
    return F.when(status.isNull(), "unknown").when(bad, "issues_found").when(status == "complete", "readable").otherwise("partial")


#: What to do next, by the technical status or the outcome of a session.
NEXT_ACTIONS = {
    "issues_found": ("Resolve the captured technical eligibility issue first.", "Verified technical check"),
    "absent": ("Investigate category association and external product evidence before rewriting the page.", "Recorded observation + diagnostic hypothesis"),
    "visible": ("Clarify the comparison fact that matters at the observed exit point.", "Recorded comparison outcome + diagnostic hypothesis"),
    "recommended": ("Preserve the baseline; do not manufacture a fix.", "Recorded observation"),
}


def next_action(result: Column, technical: Column) -> Column:
    """struct(title, evidence_type): a technical issue comes first, then what the outcome asks for."""
    kind = F.when(technical == "issues_found", "issues_found").when(result == "absent", "absent").when(result.isin("candidate", "retrieved"), "visible").otherwise("recommended")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in NEXT_ACTIONS.items() for x in (k, v[i])]), kind)
    return F.struct(pick(0).alias("title"), pick(1).alias("evidence_type"))


def target_state(observed: Column, recommendation: Column, candidate_set: Column, retrievability: Column) -> Column:
    """How far one turn's target came; a turn without an observation is not an absence."""
    return (
        F.when(~F.coalesce(observed, F.lit(False)), "not observed").when(recommendation == "final_choice", "final choice").when(recommendation == "recommended", "recommended")
        .when(candidate_set == "included", "in candidate set").when(retrievability == "retrieved", "retrieved only").otherwise("absent")
    )


def evidence_quality(turns: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Of each session: completed_turns, turns_with_sources, source_records, unique_source_domains. turns: key, turn; sources: key, turn, publisher."""
    done = turns.groupBy(key).agg(F.count("*").alias("completed_turns"))
    cited = sources.groupBy(key).agg(F.count_distinct("turn").alias("turns_with_sources"), F.count("*").alias("source_records"), F.count_distinct("publisher").alias("unique_source_domains"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("turns_with_sources", "source_records", "unique_source_domains")]
    return done.join(cited, key, "left").select(key, "completed_turns", *zero)


def session_reports(sessions: DataFrame, turns: DataFrame, sources: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """One report for each session: outcome, turn counts, evidence quality, technical status and next action; null parts for a session that still runs.

    sessions: key, terminal, interrupted; turns: key, turn, retrieved, candidate, recommended, final (booleans); sources: key, turn,
    publisher; checks: key, status, codes. Each part is one aggregate by session; they are joined on it.
    """
    flags = {n: F.col(n) for n in ("retrieved", "candidate", "recommended", "final")}
    parts = first_turns(turns, key, "turn", flags).join(evidence_quality(turns, sources, key), key)
    technical = checks.select(key, technical_summary(F.col("status"), F.col("codes")).alias("technical"))
    out = sessions.join(parts, key, "left").join(technical, key, "left").withColumn("technical", F.coalesce("technical", F.lit("unknown")))
    found = outcome(F.col("first_final"), F.col("first_recommended"), F.col("first_candidate"), F.col("first_retrieved"), F.col("interrupted"))
    shown = lambda c: F.when(F.col("terminal"), c)
    action = next_action(F.col("outcome"), F.col("technical"))
    names = [*(f"first_{n}" for n in flags), "n_turns", "turns_with_sources", "source_records", "unique_source_domains", "technical"]
    return out.withColumn("outcome", found).select(key, "terminal", shown(F.col("outcome")).alias("outcome"), shown(action["title"]).alias("next_title"), *[shown(F.col(n)).alias(n) for n in names])
