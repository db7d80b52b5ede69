"""Review of a collection by an injected model: candidates, answers, findings, report and index."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as fm
from docloom.functions import lines as ln
from docloom.functions import text as fn

from . import bm25, rules
from .answers import AnswerStore
from .search import top_per_group
from .store import stored

#: A model: a list of prompts to as many answers; it runs in tasks, a batch at a time.
Model = Callable[[list[str]], list[str]]


def ask(rows: DataFrame, model: Model, prompt: str = "prompt", answer: str = "answer", cache: DataFrame | AnswerStore | None = None) -> DataFrame:
    """Add the model's answer to each row's prompt, ``cached``, and ``error``: why there is no answer, else null.

    Equal prompts are asked once. A prompt in the cache (prompt_hash, answer) isn't asked; an ``AnswerStore`` also keeps
    the new answers, so that a second run asks nothing. A model that fails on a batch gives null answers and its
    error for the whole batch; these aren't kept. Each prompt is asked once in a job: answers are stored as they come.
    """

    @F.pandas_udf("answer string, error string")
    def call(prompts: pd.Series) -> pd.DataFrame:
        try:
            got = list(model(prompts.tolist()))
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
            return pd.DataFrame({"answer": got, "error": [None if x is not None else "no answer" for x in got]}, dtype=object)
        except Exception as error:  # noqa: BLE001  any error of a model is that of its batch
            return pd.DataFrame({"answer": [None] * len(prompts), "error": [f"{type(error).__name__}: {error}"] * len(prompts)}, dtype=object)

    keyed = rows.withColumn("_hash", F.sha2(F.col(prompt).cast("binary"), 256))
    distinct = keyed.select("_hash", F.col(prompt).alias("_prompt")).dropDuplicates(["_hash"])
    own = isinstance(cache, AnswerStore)
    entries = cache.entries() if own else cache
    if entries is not None:
        known = entries.select(F.col("prompt_hash").alias("_hash"), F.col("answer").alias("_known")).where("_known is not null").dropDuplicates(["_hash"])
        distinct = stored(distinct.join(known, "_hash", "left"), "prompts")
    else:
        distinct = distinct.withColumn("_known", F.lit(None).cast("string"))
    new = stored(distinct.where("_known is null").select("_hash", call("_prompt").alias("_a")).select("_hash", F.col("_a.answer").alias(answer), F.lit(False).alias("cached"), F.col("_a.error").alias("error")), "answers")
    if own:
        cache.put(new.select(F.col("_hash").alias("prompt_hash"), F.col(answer).alias("answer")))
    old = distinct.where("_known is not null").select("_hash", F.col("_known").alias(answer), F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    return keyed.drop("error").join(new.unionByName(old), "_hash").drop("_hash")


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", out: str = "embedding", cache: DataFrame | AnswerStore | None = None) -> DataFrame:
    """Add a model's vector for each row's text, ``cached`` and ``error``, by ``ask``; vectors are kept as JSON texts.

    Prompts and texts are hashed alike: give embeddings a store of their own.
    """
    asked = ask(rows, lambda texts: [json.dumps(list(map(float, v))) for v in model(texts)], text, "_vector", cache)
    return asked.withColumn(out, F.from_json("_vector", "array<double>")).drop("_vector")


def json_object(raw: Column) -> Column:
    """The JSON object that an answer is; null for anything else."""
    return fm.json_mapping(F.regexp_replace(raw, r"^\s+|\s+$", ""))


_text = lambda answer, key: F.coalesce(F.nullif(F.nullif(fm.field(answer, key), F.lit("0")), F.lit("false")), F.lit(""))


def duplicate_findings(answers: DataFrame) -> DataFrame:
    """a, b, summary, shared_sections, suggested_action of the answers that state a high overlap."""
    rows = answers.select("a", "b", json_object(F.col("answer")).alias("o")).where(fm.field(F.col("o"), "overlap") == "high")
    sections = F.coalesce(F.from_json(fm.field(F.col("o"), "shared_sections"), "array<string>"), F.array().cast("array<string>"))
    return rows.select("a", "b", _text(F.col("o"), "summary").alias("summary"), sections.alias("shared_sections"), _text(F.col("o"), "suggested_action").alias("suggested_action"))


def inconsistency_findings(answers: DataFrame) -> DataFrame:
    """a, b and the contradictions (issue and both quotes) of the answers that have any."""
    rows = answers.select("a", "b", F.from_json(fm.field(json_object(F.col("answer")), "contradictions"), "array<string>").alias("c"))
    item = lambda s: F.struct(*[F.coalesce(F.get_json_object(s, f"$.{k}"), F.lit("")).alias(k) for k in ("page_a_quote", "page_b_quote", "issue")])
    kept = F.transform(F.filter("c", lambda s: s.startswith("{")), item)
    return rows.select("a", "b", kept.alias("contradictions")).where(F.size("contradictions") > 0)


def stale_findings(answers: DataFrame) -> DataFrame:
    """path, replacement, evidence, last_updated of confident answers (path, answer, newer, last_updated) that name a replacement.

    The replacement is the first of the ``newer`` paths that equals it or whose name does, else the first of which
    one ends in the other, else what the model said.
    """
    o = json_object(F.col("answer"))
    rows = answers.withColumns({"_c": fm.field(o, "replacement"), "_confidence": fm.field(o, "confidence"), "_evidence": _text(o, "evidence")})
    rows = rows.where((F.col("_confidence") == "high") & (F.col("_c") != "") & ~F.col("_c").rlike(r"^[\[{]"))
    said = F.col("_c")
    exact = F.filter("newer", lambda p: (p == said) | (F.substring_index(p, "/", -1) == said))
    near = F.filter("newer", lambda p: p.endswith(said) | said.endswith(p))
    return rows.select("path", F.coalesce(F.get(exact, F.lit(0)), F.get(near, F.lit(0)), said).alias("replacement"), F.col("_evidence").alias("evidence"), "last_updated")


def pair_prompts(pairs: DataFrame, docs: DataFrame, instruction: str, key: str = "path", text: str = "text") -> DataFrame:
    """a, b, score and the prompt on each pair of documents: the instruction, then both paths and bodies."""
    one = lambda side: docs.select(F.col(key).alias(side), fm.body(F.col(text)).alias(f"_{side}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    prompt = F.concat(F.lit(instruction + "\n\n## A: "), F.col("a").cast("string"), F.lit("\n"), "_a", F.lit("\n\n## B: "), F.col("b").cast("string"), F.lit("\n"), "_b")
    return both.select("a", "b", "score", prompt.alias("prompt"))


Cache = DataFrame | AnswerStore | None


def judged_duplicates(docs: DataFrame, model: Model, instruction: str, key: str = "path", text: str = "text", k: int = 5, least: float = 0.85, cache: Cache = None) -> DataFrame:
    """The model's answers on pairs whose BM25 score is ``least`` or more."""
    return ask(pair_prompts(bm25.top_k_pairs(docs, k, least, key, text), docs, instruction, key, text), model, cache=cache)


def duplicates(docs: DataFrame, model: Model, instruction: str, key: str = "path", text: str = "text", k: int = 5, least: float = 0.85, cache: Cache = None) -> DataFrame:
    """Findings of documents that the model calls duplicates, of the pairs whose BM25 score is ``least`` or more."""
    return duplicate_findings(judged_duplicates(docs, model, instruction, key, text, k, least, cache))


def inconsistencies(docs: DataFrame, model: Model, instruction: str, key: str = "path", text: str = "text", k: int = 5, cache: Cache = None) -> DataFrame:
    """Findings of contradictions between each document and its best neighbours, those of score 0 included."""
    return inconsistency_findings(judged_duplicates(docs, model, instruction, key, text, k, 0.0, cache))


def judged_stale(docs: DataFrame, model: Model, instruction: str, now: Column, days: int, key: str = "path", text: str = "text", k: int = 3, cache: Cache = None) -> DataFrame:
    """The model's answers on old documents and their best newer neighbours. Undated documents count as newer."""
    dated = docs.select(key, text, fm.updated_at(F.col(text), fm.frontmatter(F.col(text))).alias("_date"))
    old, newer = rules.partition_stale(dated, F.col("_date"), now, days)
    near = bm25.top_k(old, docs, k, key, text, key, text, pool=newer)
    bodies = docs.select(F.col(key).alias("_n"), fm.body(F.col(text)).alias("_body"))
    item = F.struct("rank", F.col(key).alias("path"), F.col("_body").alias("body"))
    lists = near.join(bodies, F.col(key) == F.col("_n")).groupBy(F.col(f"{key}_query").alias("path")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = old.select(F.col(key).alias("path"), fm.body(F.col(text)).alias("_own"), F.date_format("_date", "yyyy-MM-dd").alias("last_updated"))
    each = F.array_join(F.transform("items", lambda s: F.concat(F.lit("\n\n## "), s["path"].cast("string"), F.lit("\n"), s["body"])), "")
    prompt = F.concat(F.lit(instruction + "\n\n# "), F.col("path").cast("string"), F.lit("\n"), "_own", each)
    rows = own.join(lists, "path").select("path", "last_updated", F.transform("items", lambda s: s["path"].cast("string")).alias("newer"), prompt.alias("prompt"))
    return ask(rows, model, cache=cache)


def stale_pages(docs: DataFrame, model: Model, instruction: str, now: Column, days: int, key: str = "path", text: str = "text", k: int = 3, cache: Cache = None) -> DataFrame:
    """Findings of old documents that one of their best newer neighbours supersedes. Undated documents count as newer."""
    return stale_findings(judged_stale(docs, model, instruction, now, days, key, text, k, cache))


def ask_counts(answers: list[DataFrame]) -> dict[str, int]:
    """Of all answers of a run: pairs (rows that were judged), calls (distinct prompts that were asked), cached and errors (rows)."""
    total = {"pairs": 0, "calls": 0, "cached": 0, "errors": 0}
    for rows in answers:
        one = rows.agg(F.count("*").alias("pairs"), F.count_distinct(F.when(~F.col("cached"), F.col("prompt"))).alias("calls"), F.count_if("cached").alias("cached"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
        total = {k: n + one[k] for k, n in total.items()}
    return total


def rewrites(docs: DataFrame, model: Model, instruction: str, key: str = "path", text: str = "text") -> DataFrame:
    """key, rewritten, changed and error: bodies that the model rewrote, with protected regions and outer blanks as they were.

    A rewrite that lost a mark is refused: rewritten is null and error says so.
    """
    parts = docs.select(key, F.col(text).alias("_text")).withColumn("_p", ln.protect("_text"))
    asked = ask(parts.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), "_p.text")), model)
    back = asked.withColumn("_back", ln.restore(F.col("answer"), F.col("_p.regions")))
    new = F.when(F.col("_back").isNotNull(), fn.keep_outer_blanks(F.col("_text"), F.col("_back")))
    error = F.when(F.col("answer").isNull(), "no answer").when(F.col("_back").isNull(), "a protected region is missing")
    return back.select(key, new.alias("rewritten"), (new != F.col("_text")).alias("changed"), error.alias("error"))


def summaries(docs: DataFrame, model: Model, instruction: str, key: str = "path", text: str = "text", section: tuple[str, ...] = ("ai",), cache: Cache = None) -> DataFrame:
    """key, summary and cached: the frontmatter's summary while its summary_input_hash is the body's hash, else the model's; null if it fails."""
    rows = docs.select(key, F.col(text).alias("_text"), fm.frontmatter(F.col(text)).alias("_fm")).withColumn("_body", fm.body(F.col("_text")))
    same = fm.field(F.col("_fm"), *section, "summary_input_hash") == fn.body_hash(F.col("_body"))
    known = F.when(same, F.nullif(fm.field(F.col("_fm"), *section, "summary"), F.lit("")))
    rows = rows.withColumn("summary", known)
    new = ask(rows.where("summary is null").select(key, F.concat(F.lit(instruction + "\n\n"), "_body").alias("prompt")), model, cache=cache)
    return rows.where("summary is not null").select(key, "summary", F.lit(True).alias("cached")).unionByName(new.select(key, F.col("answer").alias("summary"), F.lit(False).alias("cached")))


def index_text(summary: DataFrame, clusters: DataFrame | None = None, heading: str = "# Index\n", key: str = "path") -> DataFrame:
    """One row with the text of an index: a bullet for each summary, by path; in clusters (ord, topic, paths), what none claims under Other.

    A path that a cluster names without a summary has an empty one; clusters without paths are left out.
    """
    bullet = lambda path, text: F.concat(F.lit("- **["), fn.path_title(path), F.lit("]("), path, F.lit(")** — "), text, F.lit("\n"))
    rows = summary.where("summary is not null").select(F.col(key).alias("path"), "summary")
    joined = lambda d: d.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda s: s["line"]), ""), F.lit("")).alias("body"))
    if clusters is None:
        body = joined(rows.withColumn("line", bullet(F.col("path"), F.col("summary"))))
        return body.select(F.concat(F.lit(heading + "\n"), "body").alias("text"))
    claimed = clusters.where(F.size("paths") > 0).select("ord", "topic", F.posexplode("paths").alias("at", "path"))
    lines = claimed.join(rows, "path", "left").withColumn("line", bullet(F.col("path"), F.coalesce("summary", F.lit(""))))
    sections = lines.groupBy("ord", "topic").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select("ord", F.concat(F.lit("\n## "), "topic", F.lit("\n\n"), F.array_join(F.transform("l", lambda s: s["line"]), "")).alias("section"))
    rest = joined(rows.join(claimed.select("path").distinct(), "path", "left_anti").withColumn("line", bullet(F.col("path"), F.col("summary"))))
    other = rest.where("body <> ''").select(F.lit(2**31 - 1).alias("ord"), F.concat(F.lit("\n## Other\n\n"), "body").alias("section"))
    whole = sections.select(F.col("ord").cast("int"), "section").unionByName(other).agg(F.array_sort(F.collect_list(F.struct("ord", "section"))).alias("s"))
    return whole.select(F.concat(F.lit(heading), F.array_join(F.transform("s", lambda x: x["section"]), "")).alias("text"))


def one_cluster(summary: DataFrame, key: str = "path") -> DataFrame:
    """The clusters when no model can name topics: all paths under Pages."""
    return summary.where("summary is not null").agg(F.array_sort(F.collect_list(key)).alias("paths")).select(F.lit(0).alias("ord"), F.lit("Pages").alias("topic"), "paths")


def _grouped(items: DataFrame, model: Model, instruction: str, most_chars: int, cache: Cache) -> tuple[DataFrame, int, int]:
    """name and topic of items (name, line) by the model, in prompts of about ``most_chars``; the number of prompts and of failures."""
    sized = items.select("name", "line", (F.length("line") + 1).alias("_n"))
    total = sized.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // most_chars))
    part = sized.withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(parts)) if total > most_chars else F.lit(0))
    so_far = F.sum("_n").over(Window.partitionBy("_part").orderBy("name"))
    part = part.withColumn("_sub", F.floor((so_far - 1) / most_chars))
    chunks = part.groupBy("_part", "_sub").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("items"))
    prompts = chunks.select("items", F.concat(F.lit(instruction + "\n\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("prompt"))
    answers = stored(ask(prompts, model, cache=cache), "topics")
    clusters = F.from_json(fm.field(json_object(F.col("answer")), "clusters"), "array<struct<topic:string,paths:array<string>>>")
    good = F.filter(clusters, lambda c: c["topic"].isNotNull() & c["paths"].isNotNull())
    count = answers.agg(F.count("*").alias("n"), F.count_if(clusters.isNull()).alias("bad")).first()
    claims = answers.select("items", F.posexplode(good).alias("at", "c")).select("items", "at", F.col("c.topic").alias("topic"), F.explode("c.paths").alias("name"))
    claims = claims.where(F.exists("items", lambda x: x["name"] == F.col("name")))
    return claims.groupBy("name").agg(F.min_by("topic", "at").alias("topic")), count["n"], count["bad"]


def topics(summary: DataFrame, model: Model, instruction: str, key: str = "path", most_chars: int = 20_000, rounds: int = 8, cache: Cache = None) -> DataFrame:
    """Clusters (ord, topic, paths) of summaries, as the model names them: one row for each topic, by its first path.

    Summaries are asked in prompts of about ``most_chars`` at most, a name beyond that alone; the topics of all prompts are then
    grouped in the same way, and so on until one prompt holds them, so no prompt and no task grows with the collection.
    A path that several topics of one answer claim goes to the first; one that none claims, or that wasn't asked for,
    is left out (``index_text`` puts it under Other). If an answer can't be read, all paths are one cluster.
    """
    rows = summary.where("summary is not null").select(F.col(key).cast("string").alias("name"), F.concat(F.lit("- "), F.col(key).cast("string"), F.lit(": "), F.col("summary")).alias("line"))
    found, prompts, bad = _grouped(rows, model, instruction, most_chars, cache)
    found = stored(found, "topics-of-paths")
    while prompts > 1 and not bad and rounds:
        names = found.select("topic").distinct().select(F.col("topic").alias("name"), F.concat(F.lit("- "), "topic").alias("line"))
        wider, now, bad = _grouped(names, model, instruction, most_chars, cache)
        wider = wider.select(F.col("name").alias("topic"), F.col("topic").alias("_wider"))
        found = stored(found.join(wider, "topic", "left").select("name", F.coalesce("_wider", "topic").alias("topic")), "topics-of-paths")
        rounds = rounds - 1 if now < prompts else 0
        prompts = now
    if bad:
        return one_cluster(summary, key)
    lists = found.groupBy("topic").agg(F.array_sort(F.collect_list("name")).alias("paths"))
    return lists.select((F.row_number().over(Window.orderBy(F.element_at("paths", 1), "topic")) - 1).alias("ord"), "topic", "paths")


def report_text(findings: dict[str, DataFrame], scope: str, date: str, counts: dict[str, int]) -> DataFrame:
    """One row with the text of a review report: a section for each mode that ran (duplicates, inconsistencies, stale) and the run's counts.

    A finding becomes one text where it is; only these are gathered, in their order. Findings are what a person reads.
    """
    q = lambda c: F.concat(F.lit("`"), F.col(c).cast("string"), F.lit("`"))
    quote = lambda who, text: F.when(text != "", F.concat(F.lit("\n  - "), who, F.lit(': "'), text, F.lit('"'))).otherwise("")
    bullet = lambda label, c: F.when(c != "", F.concat(F.lit(f"\n- **{label}:** "), c)).otherwise("")
    made = {
        "duplicates": ("## Likely duplicates", "_No high-overlap duplicates found._", lambda d: d.select(F.struct("a", "b").cast("string").alias("k"), F.concat(F.lit("### "), q("a"), F.lit(" and "), q("b"), F.lit("\n"), bullet("Overlap", F.col("summary")), bullet("Shared sections", F.array_join("shared_sections", ", ")), bullet("Suggested action", F.col("suggested_action")), F.lit("\n")).alias("t"))),
        "inconsistencies": ("## Possible inconsistencies", "_No contradictions found._", lambda d: d.select(F.struct("a", "b").cast("string").alias("k"), F.concat(F.lit("### "), q("a"), F.lit(" and "), q("b"), F.lit("\n\n"), F.array_join(F.transform("contradictions", lambda c: F.concat(F.lit("- **Issue:** "), c["issue"], quote(q("a"), c["page_a_quote"]), quote(q("b"), c["page_b_quote"]))), "\n"), F.lit("\n")).alias("t"))),
        "stale": ("## Stale content", "_No superseded pages found._", lambda d: d.select(F.col("path").cast("string").alias("k"), F.concat(F.lit("### "), q("path"), F.lit("\n"), F.when(F.col("last_updated") != "", F.concat(F.lit("\n- Last updated "), "last_updated")).otherwise(""), F.lit("\n- **Likely superseded by:** "), q("replacement"), bullet("Evidence", F.col("evidence")), F.lit("\n- **Suggested action:** archive or delete the stale page; add a redirect note pointing at the newer page.\n")).alias("t"))),
    }
    spark = next(iter(findings.values())).sparkSession
    out = spark.range(1).select(F.lit(f"# AI Review Report\n\n**Scope:** {scope}  \n**Date:** {date}\n").alias("text"))
    for mode, rows in findings.items():
        title, none, texts = made[mode]
        one = texts(rows).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("s"))
        body = F.when(F.size("s") == 0, F.lit(none + "\n")).otherwise(F.array_join(F.transform("s", lambda x: x["t"]), "\n"))
        section = one.select(F.concat(F.lit(f"\n{title}\n\n"), body).alias("section"))
        out = out.join(F.broadcast(section), how="cross").select(F.concat("text", "section").alias("text"))  # one row each
    footer = f"\n---\n\n## Run summary\n\n- **Modes:** {', '.join(findings)}\n- **Pairs judged:** {counts.get('pairs', 0)}\n- **API calls:** {counts.get('calls', 0)}  |  **Cached:** {counts.get('cached', 0)}\n- **Errors:** {counts.get('errors', 0)}\n"
    return out.select(F.concat("text", F.lit(footer)).alias("text"))


def run_counts(calls: DataFrame) -> DataFrame:
    """One row on a run's model calls (cached, prompt_tokens, completion_tokens, cost_usd): calls, cached, tokens and cost; unknown cost counts 0."""
    return calls.agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("cached_calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def best_neighbours(scored: DataFrame, k: int, query: str, key: str) -> DataFrame:
    """The k best of each query of a scored table; ties by key."""
    return top_per_group(scored, query, [F.desc("score"), F.col(key)], k)
