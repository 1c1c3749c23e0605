"""Scores of rankings against gold sets; prompt gate decisions; folds; staged flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import config as C
from pagewright.functions import text as X


def first_rank(items: DataFrame, results: DataFrame, gold: DataFrame) -> DataFrame:
    """Each item's first rank with a gold page; null where none. ``items`` keep all, failed ones too."""
    hit = results.join(gold, ["query_id", "page"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return items.select("query_id").join(hit, "query_id", "left")


def rank_metrics(ranks: DataFrame, results: DataFrame) -> DataFrame:
    """One row; rates over all items, sizes over the items that have results."""
    r = F.col("rank")
    share = lambda c: F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0)))
    a = ranks.agg(F.count("*").alias("items"), share(F.coalesce(r <= 1, F.lit(False))).alias("r1"), share(F.coalesce(r <= 3, F.lit(False))).alias("r3"), share(r.isNotNull()).alias("rk"), F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0))).alias("mrr"))
    b = results.groupBy("query_id").agg(F.sum("chars").alias("chars"), F.count_distinct("page").alias("pages")).agg(F.avg("chars").alias("avg_chars"), F.avg(F.col("chars") / F.lit(4.0)).alias("avg_tokens"), F.avg("pages").alias("avg_pages"))
    return a.crossJoin(b)


def label(text: Column, current: Column, stale: Column) -> Column:
    """C with any current marker in the text, else S with any stale one, else a dash."""
    body = X.marker_norm(text)
    has = lambda markers: F.exists(F.coalesce(markers, F.array().cast("array<string>")), lambda m: F.contains(body, X.marker_norm(m)))
    return F.when(has(current), "C").when(has(stale), "S").otherwise("-")


def label_strings(labelled: DataFrame) -> DataFrame:
    """The labels of each item's window in order of rank."""
    return labelled.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "").alias("labels"))


def label_metrics(strings: DataFrame) -> DataFrame:
    """X@1, X@k, and order: a C in the window with no S before the first C. Over items that ran."""
    c, s = F.instr("labels", "C"), F.instr("labels", "S")
    rate = lambda x: F.avg(x.cast("double"))
    return strings.agg(F.count("*").alias("items"), rate(F.col("labels").startswith("C")).alias("at_1"), rate(c > 0).alias("at_k"), rate((c > 0) & ((s == 0) | (s > c))).alias("in_order"))


def trivial(prompt: Column) -> Column:
    """F05."""
    p = X.strip(F.coalesce(prompt, F.lit("")))
    return (p == "") | p.startswith("/") | p.rlike(C.HARNESS) | p.rlike(C.TRIVIAL) | (F.length(p) < 12) | (F.size(F.split(p, r"\s+")) < 3)


def feature(cosine: Column, which: str, models: tuple[str, str]) -> Column:
    """one model's raw cosine, or the mean of those present."""
    a, b = cosine[models[0]], cosine[models[1]]
    return {"first": a, "second": b}[which] if which != "mean" else F.coalesce((a + b) / F.lit(2.0), a, b)


def picks(candidates: DataFrame, feature_col: str, threshold: Column | float | None, keys: tuple[str, ...] = ("query_id",), most: int = C.DEFAULTS.recall_pointers) -> DataFrame:
    """The first candidate of each page that clears the bar, ``most`` pages in order of rank. Missing features never do."""
    f = F.col(feature_col)
    ok = candidates.filter(f.isNotNull() if threshold is None else f >= threshold)
    first = W.partitionBy(*keys, "page").orderBy("rank")
    order = W.partitionBy(*keys).orderBy("rank")
    one = ok.withColumn("_t", F.row_number().over(first)).filter("_t = 1")
    return one.withColumn("_t", F.row_number().over(order)).filter(F.col("_t") <= most).drop("_t")


def decide(prompts: DataFrame, candidates: DataFrame, chosen: DataFrame, feature_col: str) -> DataFrame:
    """Trivial, then no hits, then no embedder, then the threshold: ``action, reason, top, pointers``."""
    pool = candidates.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(F.coalesce(F.col(feature_col), F.lit(0.0))).alias("top"), F.max(F.col("strategy").startswith("cosine").cast("int")).alias("embedded"))
    got = chosen.groupBy("query_id").agg(F.count("*").alias("pointers"))
    j = prompts.join(pool, "query_id", "left").join(got, "query_id", "left")
    skip = F.col("trivial")
    none = F.coalesce("hits", F.lit(0)) == 0
    blind = F.col("embedded") == 0
    action = F.when(skip, "skip").when(none, "none").when(blind, "skip").when(F.coalesce("pointers", F.lit(0)) > 0, "inject").otherwise("none")
    reason = F.when(skip, "trivial").when(none, "no-hits").when(blind, "no-embedder").otherwise("")
    open_ = ~skip & ~none & ~blind
    return j.select("query_id", action.alias("action"), reason.alias("reason"), F.when(open_, F.col("top")).alias("top"), F.when(open_, F.coalesce("pointers", F.lit(0))).otherwise(F.lit(0)).alias("pointers"))


def excerpts(chunks: DataFrame, key: list[str], text: str = "text", prompt: str = "prompt", cap: int = C.DEFAULTS.excerpt_cap) -> DataFrame:
    """Of each chunk the line of 25 characters or more that shares most long words with the prompt; the first wins."""
    lines = chunks.select(*key, X.long_words(F.col(prompt)).alias("_w"), F.posexplode(F.split(text, "\n")).alias("_i", "_l"))
    lines = lines.withColumn("_l", X.strip(F.regexp_replace(X.strip(F.col("_l")), r"^[#>\-*| ]+", ""))).filter(F.length("_l") >= 25)
    shared = lines.withColumn("_n", F.size(F.array_intersect("_w", X.long_words(F.col("_l")))))
    best = shared.groupBy(*key).agg(F.max_by("_l", F.struct("_n", -F.col("_i"))).alias("_l"))
    plain = F.regexp_replace(F.regexp_replace("_l", r"\*\*|`", ""), r"\s+", " ")
    return best.select(*key, F.when(F.length(plain) > cap, F.concat(F.rtrim(F.substring(plain, 1, cap)), F.lit("…"))).otherwise(plain).alias("excerpt"))


def gates(ideas: DataFrame, names: tuple[str, ...] = ("premises", "value", "novelty")) -> DataFrame:
    """Gates in order, each ``pass``, ``fail`` or ``error``; the first that does not pass ends it. An error is no refutation."""
    failed = F.coalesce(*(F.when(F.col(n) != "pass", F.lit(n)) for n in names))
    how = F.coalesce(*(F.when(F.col(n) != "pass", F.col(n)) for n in names))
    outcome = F.when(how.isNull(), "survived").when(how == "error", "errored").otherwise("refuted")
    return ideas.withColumns({"outcome": outcome, "gate": F.coalesce(failed, F.lit("")), "ran": sum((F.when(F.coalesce(*([F.when(F.col(m) != "pass", F.lit(1)) for m in names[:i]] or [F.lit(None).cast("int")])).isNull(), 1).otherwise(0) for i in range(len(names))), F.lit(0))})


def units(flow: DataFrame) -> DataFrame:
    """Draft, verify, revise by unit; no findings skips revise; a dead stage marks its own unit only."""
    error = F.when(~F.col("draft_ok"), "draft").when(~F.col("verify_ok"), "verify").when((F.col("findings") > 0) & ~F.col("revise_ok"), "revise")
    status = F.when(error.isNotNull(), "error").when(F.col("findings") > 0, "revised").otherwise("drafted")
    return flow.withColumns({"status": status, "error_stage": F.coalesce(error, F.lit(""))})


def fold(log: DataFrame, folded: DataFrame, k: int) -> DataFrame:
    """The oldest 2^k entries not folded yet, one row: the fold's id and its size; ``short`` where there are fewer."""
    size = 1 << k
    batch = log.join(folded, "entry_id", "left_anti").orderBy("entry_date", "entry_id").limit(size)
    name = F.format_string(f"fold-k{k}-from-%s-to-%s-n%d", F.min("entry_date"), F.max("entry_date"), F.count("*"))
    return batch.agg(name.alias("fold_id"), F.count("*").alias("entries"), (F.count("*") < size).alias("short"))


def log_entries(lines: DataFrame, text: str = "text") -> DataFrame:
    """The entries among a log's lines: ``entry_date, category, title, body, links, paths`` beside the lines' columns.

    An entry is one line, ``- DATE · category · **title** — body``; the category may be absent. ``links`` are the page names in double
    brackets, ``paths`` the code spans that hold a slash.
    """
    part = lambda i: F.regexp_extract(text, C.LOG_ENTRY, i)
    of = lines.filter(F.col(text).rlike(C.LOG_ENTRY)).withColumns({"entry_date": part(1), "category": F.nullif(part(2), F.lit("")), "title": part(3), "body": X.strip(part(4))})
    code = F.regexp_extract_all(text, F.lit("`([^`]*/[^`]*)`"), F.lit(1))
    return of.withColumns({"links": F.transform(F.regexp_extract_all(text, F.lit(C.WIKILINK), F.lit(1)), X.strip), "paths": code})


def oldest_unfolded(entries: DataFrame, children: DataFrame, k: int, line: str = "line") -> DataFrame:
    """The 2^k entries nearest to the end of a log that has its newest first, without those that a fold holds already.

    ``children``: (entry_date, title) of all folds.
    """
    return entries.join(children.select("entry_date", "title").distinct(), ["entry_date", "title"], "left_anti").orderBy(F.col(line).desc()).limit(1 << k)


def best_of_sweep(sweep: DataFrame, features: tuple[str, ...] = ("first", "second", "mean")) -> DataFrame:
    """The row of a sweep with the largest product of precision and recall; of equals the first, by feature, then step."""
    turn = F.array_position(F.array(*(F.lit(x) for x in features)), F.col("feature"))
    return sweep.orderBy((F.col("precision_") * F.col("recall_")).desc(), turn, "step").limit(1)


def sections(chunks: DataFrame, heads: DataFrame, reach: int = 2) -> DataFrame:
    """``section`` of each chunk: its own first line if that is an H2 heading, else the last heading that starts at most ``reach``
    characters after the chunk, else null.

    ``chunks``: (page, chunk_index, pos, raw_text); ``heads``: (page, start, heading). Both are laid on one line of positions, so this is a sort by
    page and no join; a page's rows are what one task must order.
    """
    opening = F.substring_index(X.strip(F.col("raw_text")), "\n", 1)
    marks = heads.select("page", (F.col("start") - reach).alias("_at"), F.lit(0).alias("_kind"), F.col("start").alias("_start"), "heading")
    rows = chunks.withColumns({"_at": F.col("pos"), "_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("page").orderBy("_at", "_kind", "_start").rowsBetween(W.unboundedPreceding, 0)
    inherited = F.last("heading", ignorenulls=True).over(w)
    own = F.when(opening.startswith("## "), opening)
    return rows.withColumn("section", F.coalesce(own, inherited)).filter("_kind = 1").drop("_at", "_kind", "_start", "heading")


def window_costs(chunks: DataFrame) -> DataFrame:
    """For each page with a returned chunk, ``distance`` from an answer chunk to the nearest returned one, ``same_section`` where some
    answer shares a section with a returned chunk, and the characters that all other chunks of the returned ones' sections would add.

    ``chunks``: (page, chunk_index, section, raw_text, returned, answer). No heading is a section too.
    """
    by_index, by_section = W.partitionBy("page").orderBy("chunk_index"), W.partitionBy("page", "section")
    mine = F.when(F.col("returned"), F.col("chunk_index"))
    before = F.last(mine, ignorenulls=True).over(by_index.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(mine, ignorenulls=True).over(by_index.rowsBetween(0, W.unboundedFollowing))
    near = F.least(F.col("chunk_index") - before, after - F.col("chunk_index"))
    seen = chunks.withColumns({"_near": near, "_shared": F.max("returned").over(by_section)})
    extra = F.sum(F.when(F.col("_shared") & ~F.col("returned"), F.length("raw_text")).otherwise(0))
    answers = F.max(F.when(F.col("answer"), F.col("_shared")))
    return seen.groupBy("page").agg(F.max("returned").alias("_any"), F.min(F.when(F.col("answer"), F.col("_near"))).alias("distance"), answers.alias("same_section"), extra.cast("long").alias("extra_section")).filter("_any").drop("_any")


def run_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Two runs (query_id, rank, labels) side by side: ``new`` or ``gone`` where only one has the query, ``same`` where rank and
    labels agree (missing ones too), else ``changed``."""
    n = new.select("query_id", F.col("rank").alias("new_rank"), F.col("labels").alias("new_labels"), F.lit(1).alias("_n"))
    o = old.select("query_id", F.col("rank").alias("old_rank"), F.col("labels").alias("old_labels"), F.lit(1).alias("_o"))
    same = F.col("new_rank").eqNullSafe(F.col("old_rank")) & F.col("new_labels").eqNullSafe(F.col("old_labels"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(same, "same").otherwise("changed")
    return n.join(o, "query_id", "full_outer").withColumn("state", state).drop("_n", "_o")


def judge_summary(verdicts: DataFrame) -> DataFrame:
    """How often each relation was found, and its mean time. ``verdicts``: (relation, seconds)."""
    return verdicts.groupBy(F.coalesce("relation", F.lit("none")).alias("relation")).agg(F.count("*").alias("pairs"), F.avg("seconds").alias("mean_seconds"))


def keep_last(log: DataFrame, order: list[str], rows: int = C.DEFAULTS.log_keep) -> DataFrame:
    """The log's last rows after rotation."""
    return log.orderBy(*(F.col(c).desc() for c in order)).limit(rows)


def rotated(log: DataFrame, line: Column, order: list[str], settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """The log as it is while its lines have at most ``log_bytes`` bytes (with their ends), else its last ``log_keep`` rows."""
    size = log.agg(F.sum(F.octet_length(line) + 1)).first()[0] or 0
    return keep_last(log, order, settings.log_keep) if size > settings.log_bytes else log


def idea_fault(settings: C.Settings = C.DEFAULTS) -> Column:
    """Why an idea is dropped, null if it is kept: shape, then kind, then each quote's length and place on its own side.

    Columns: ``title, idea, first_step, quote_a, quote_b, kind, text_a, text_b``.
    """
    missing = [F.when(F.coalesce(X.strip(F.col(f)), F.lit("")) == "", f"missing {f}") for f in C.IDEA_FIELDS]
    kind = F.when(~F.coalesce(F.col("kind").isin(*C.IDEA_KINDS), F.lit(False)), F.concat(F.lit("kind "), F.coalesce("kind", F.lit("none"))))
    quotes = []
    for side in ("a", "b"):
        q = X.quote_norm(F.col(f"quote_{side}"))
        quotes.append(F.when(F.length(q) < settings.quote_chars, f"quote_{side} too short"))
        quotes.append(F.when(~F.contains(X.quote_norm(F.col(f"text_{side}")), q), f"quote_{side} not in passage {side.upper()}"))
    return F.coalesce(*missing, kind, *quotes)


def verdict_kept() -> Column:
    """a judge's verdict counts only with a known relation and both quotes verbatim on their sides."""
    verbatim = [F.contains(X.quote_norm(F.col(f"text_{x}")), X.quote_norm(F.col(f"quote_{x}"))) & (X.quote_norm(F.col(f"quote_{x}")) != "") for x in ("a", "b")]
    return F.coalesce(F.col("relation").isin(*C.PAIR_RELATIONS) & verbatim[0] & verbatim[1], F.lit(False))


def proposal_order(ideas: DataFrame, cosine: str = "nearest") -> DataFrame:
    """Proposals from the farthest to the nearest to what there is; one without a cosine counts as 0."""
    return ideas.withColumn("place", F.row_number().over(W.orderBy(F.coalesce(cosine, F.lit(0.0)), "idea_id")))
