"""Rules without a SQL form, by hand and against plain Python."""

import datetime
import re

import numpy as np
from pyspark.sql import functions as F

from transcriptlab.functions import rules as R
from transcriptlab.operators import choose, reports, terms
from transcriptlab.sources import io
from transcriptlab.streaming import jobs


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_asserted(spark):
    rows = [
        ("we ship on friday", "ship on friday", True), ("we do not ship on friday", "ship on friday", False), ("don't ship on friday", "ship on friday", False), ("do not forget to ship on friday", "ship on friday", False),
        ("do not please ever ship it", "ship it", False), ("we no longer really ship it", "ship it", False), ("do not call it a blocker", "blocker", False), ("ship it is not the default now", "ship it", False),
        ("not now but ship it", "ship it", True), ("no way, then ship it; never ship it", "ship it", True), ("", "x", False), ("anything", "", False), (None, "x", False), ("mat ship it", "ship it", False),
    ]
    got = values(spark, rows, "actual string, phrase string, want boolean", R.asserted(F.col("actual"), F.col("phrase")), "want")
    assert [a for a, _ in got] == [w for _, w in got], [(r, g) for r, g in zip(rows, got, strict=True) if g[0] != g[1]]
    more = values(spark, [("we must not delete it", ["must"], ["delete it"]), ("delete it", ["must"], None), ("we must delete it", ["must"], ["delete it"]), ("x", None, None)], "a string, r array<string>, f array<string>", R.required_and_forbidden(F.col("a"), F.col("r"), F.col("f")))
    assert [x for x, in more] == [False, True, True, False]


def test_rewrites(spark):
    rows = [("Pay 20,5 or 30 to the API, do not call OpenAI v2x", "pay 30 to the api and call"), ("kya hai", "what is it"), ("same", "same")]
    got = [x for x, in values(spark, rows, "d string, f string", R.rewrite_safety(F.col("d"), F.col("f")))]
    assert got[0].numbers == ["20,5"] and got[0].negations == ["not"] and got[0].terms == ["OpenAI", "v2x"] and not got[0].mixed
    assert got[1].mixed and not got[2].mixed and got[2].terms == []
    reviews = values(spark, [("short", "short?"), ("a", "a. b. c. d. e and some more")], "d string, f string", R.rewrite_reviews(F.col("d"), F.col("f")))
    assert [x for x, in reviews] == [["question_mark_added"], ["large_char_delta", "large_sentence_delta"]]
    text = "please FIX for a  Cursor ChatGPT now. Company data cannot go to cloud, so it should be a solution because x; this should be possible because y"
    polished = [x for x, in values(spark, [(text,), ("it should be a solution because",), ("work data can't move to the cloud. this needs to be possible because z",), ("a local tool: company data cannot go to cloud, it should be possible because",)], "t string", R.work_polish(F.col("t")))]
    assert polished[0].text == "please FIX a Cursor ChatGPT problem now. Company data cannot go to cloud, so This tool should be local because x; this should be possible because y"
    assert polished[0].rules == ["product_problem_phrase", "local_tool_cloud_clause"] and polished[1].rules == [] and polished[2].text.endswith("This tool should be local because z") and polished[3].rules == []


def test_risks_and_plausibility(spark):
    risks = values(spark, [("", None), ("very unclear words here today", "x"), ("go go go go go go go go go go go go", None), ("a fine text of many words", None)], "t string, e string", R.fast_risks(F.col("t"), F.col("e")))
    assert [x for x, in risks] == [["fast_empty", "fast_too_short"], ["fast_error", "fast_unclear_marker"], ["fast_repetition"], []]
    assert values(spark, [("㐀", None), ("豈", None), ("𠀀", "x"), ("あ", None)], "t string, e string", R.script_risks(F.col("t"), F.col("e"))) == [(["detector_chinese"],), (["detector_chinese"],), (["detector_error", "detector_chinese"],), ([],)]
    assert values(spark, [("नम 中", None)], "t string, e string", R.script_risks(F.col("t"), F.col("e"))) == [(["detector_devanagari", "detector_chinese"],)]
    plausible = values(spark, [("open the document in the office window and type", True), ("Thank you.", False), (" ", False), ("नमस्ते", False)], "t string, x boolean", R.plausibility(F.col("t"), F.col("x")))
    assert [x for x, in plausible] == [1.0, -0.45, -10.0, 0.05]
    aliases = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(c).alias("canonical")) for a, c in (("chat gpt", "chatgpt"), ("kubernetes", "k8s"), ("api", "api"))])
    assert values(spark, [("Kuber netes and Chat-GPT",), ("rapid apis",)], "t string", R.dictionary_terms(F.col("t"), aliases)) == [(["chatgpt", "k8s"],), ([],)]
    assert values(spark, [("ok", "haan baat kaam woh")], "d string, f string", R.value_delta(F.col("d"), F.col("f"))) == [(["baat", "kaam"],)]
    assert values(spark, [("rec_2026-01-02T03-04-05-678Z__9",), ("Other Id!",)], "v string", R.stamped_id(F.col("v"), r"rec_(\d{4})-(\d{2})-(\d{2})T(\d{2})-(\d{2})-(\d{2})-\d+Z__(\d+)", "s_")) == [("s_20260102_030405_9",), ("s_other_id",)]


def test_rewrite_by_a_dictionary(spark):
    texts = ["Chat GPT and chatgpt, c++ or C++!", "risk if I'd go; risk if I go", None, "nothing", "ääpi api APIs $5"]
    fixes, aliases = [("risk if i", "Riskified"), ("risk if i'd", "Riskified inc"), ("c++", "C plus $1\\")], [("chat gpt", "ChatGPT"), ("chatgpt", "ChatGPT"), ("api", "API"), ("gpt and", "never")]
    schema = "wrong string, right string"
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in terms.rewrite(rows, spark.createDataFrame(fixes, schema), spark.createDataFrame(aliases, schema)).collect()}
    for i, text in enumerate(texts):
        want = text or ""
        for group in (fixes, aliases):
            for wrong, right in sorted(group, key=lambda x: -len(x[0])):
                want = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda _, r=right: r, want, flags=re.I)
        assert got[i] == want


def cover(letters, known):
    if letters in known:
        return letters
    out, at = [], 0
    while at < len(letters):
        found = []
        for place, term in enumerate(known):
            part = letters[at : at + len(term)]
            off = sum(a != b for a, b in zip(part, term, strict=True)) if len(part) == len(term) else 9
            if off == 0 or (off == 1 and len(term) >= 3 and part[:2] == term[:2]):
                found.append((off, -len(term), place))
        if not found:
            return None
        out.append(known[min(found)[2]])
        at += len(out[-1])
    return ", ".join(out) if len(out) >= 2 else None


def test_spelled_acronyms(spark):
    known = sorted(("API", "MCP", "ASR", "UX", "LLMS"), key=lambda a: (-len(a), a))
    texts = ["the A P I and M, C, P", "A P I M C B now", "X Y Z", "A P L U X", "L L M S A S R", "no B", "a P I", ""]
    got = values(spark, [(t,) for t in texts], "t string", terms.spelled_acronyms(F.col("t"), ("API", "MCP", "ASR", "UX", "LLMS", "OK")))
    want = [re.sub(terms.SPELLED, lambda m: cover(re.sub("[^A-Z]", "", m[0]), known) or m[0], t) for t in texts]
    assert [x for x, in got] == want and want[0] == "the API and MCP" and want[3] == "API, UX"


def test_segment_choice(spark):
    rows = [
        (1, "this is fine now", None, "haan yaar this is fine now kya", None, "second"), (2, "this is fine now", None, "haan kya", None, "fast"), (3, "", None, "one two three", None, "second"), (4, "bad", "boom", None, None, "fast"),
        (5, "Yes, look at that thing", None, "dekh yes at that thing", None, "second"), (6, "plain words stay here", None, "other words stay here", None, "fast"), (7, "a long text of many words that goes on and on here", None, "haan yaar kya hai", None, "fast"),
    ]
    out = choose.segment_choice(spark.createDataFrame(rows, "i int, fast string, fast_error string, second string, second_error string, want string")).collect()
    assert {r.i: r.chosen for r in out} == {r.i: r.want for r in out}
    assert {r.chosen for r in choose.segment_choice(spark.createDataFrame(rows, "i int, fast string, fast_error string, second string, second_error string, want string"), "fast").collect()} == {"fast"}
    wanted = values(spark, [("haan", "x", None, 99.0), ("hello", "fast_server_native", None, 5.0), ("hello", "fast_server_native", None, 50.0), ("hello", "x", True, 50.0), ("hello", "x", None, None)], "t string, r string, k boolean, s double", choose.polish_wanted(F.col("t"), F.col("r"), F.col("k"), F.col("s"), 10.0))
    assert [tuple(x) for x, in wanted] == [(True, True), (True, False), (False, False), (True, True), (False, False)]


def test_exclusive_quantiles(spark):
    import statistics

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(0, 1, 57).round(3).tolist(), "b": [1.0, 2.0], "c": [7.0], "d": rng.integers(0, 4, 200).astype(float).tolist()}
    rows = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, v double")
    got = {r.g: r.value for r in reports.exclusive(rows, "g", "v", 0.95).collect()}
    assert all(abs(got[g] - (v[0] if len(v) == 1 else statistics.quantiles(v, n=20)[18])) < 1e-9 for g, v in groups.items())


def test_sinks_and_streams(spark, tmp_path):
    now = datetime.datetime(2026, 1, 2, 3, 4, 5)
    events = spark.createDataFrame([("open", "s1", now), ("open", "s1", now + datetime.timedelta(minutes=5)), ("buy", "s2", now + datetime.timedelta(hours=2))], "event string, session_id string, created_at timestamp")
    for _ in range(2):
        io.append_events(events, f"{tmp_path}/events")
    assert spark.read.json(f"{tmp_path}/events").count() == 6
    for batch in ("a", "b", "a"):
        io.write_results(events.filter("event = 'open'"), f"{tmp_path}/results", batch)
    assert io.read_results(spark, f"{tmp_path}/results").groupBy("batch").count().collect() and io.read_results(spark, f"{tmp_path}/results").count() == 4
    assert {(r.event, r.n) for r in jobs.funnel(events, late=None).collect()} == {("open", 2), ("buy", 1)} and {(r.session_id, r.n) for r in jobs.event_sessions(events, late=None).collect()} == {("s1", 2), ("s2", 1)}
    stream = spark.readStream.schema(events.schema).json(f"{tmp_path}/events")
    query = jobs.funnel(stream).writeStream.format("memory").queryName("funnel").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.event, r.n) for r in spark.table("funnel").collect()} == {("open", 4), ("buy", 2)}
    chunks = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 9.9), ("q", 0, 9.0)], "run_id string, index int, written_at double")
    assert {(r.run_id, r["index"], r.pending) for r in jobs.ready_chunks(chunks, 10.0).collect()} == {("r", 0, True), ("q", 0, False)}
    ends = spark.createDataFrame([(False, False, False, False, []), (True, True, True, False, []), (True, False, False, False, ["late"]), (True, True, True, True, []), (True, False, False, False, [])], "risk boolean, pending boolean, timed_out boolean, merged boolean, reasons array<string>")
    assert [r.route for r in jobs.route_outcome(ends).collect()] == ["no_risk", "pending", "rejected", "partial", "safe"]


def test_readers_of_clips_and_attempts(spark, tmp_path):
    (tmp_path / "clips.json").write_text('[{"id": "1", "audio": "a", "gold": "g"}, {"id": "2", "audio": "", "gold": "g"}, {"id": "3", "audio": "a", "gold": " "}]')
    assert [r.id for r in io.read_clips(spark, str(tmp_path / "clips.json")).collect()] == ["1"]
    (tmp_path / "log.jsonl").write_text('{"run_id": "1", "created_at": "2026-01-02T03:04:05Z", "status": "failed"}\n[1]\n')
    rows = io.read_attempts(spark, str(tmp_path / "log.jsonl"))
    for _ in range(2):
        io.append_attempts(rows, f"{tmp_path}/attempts")
    assert spark.read.parquet(f"{tmp_path}/attempts").filter("run_id = '1'").count() == 2
