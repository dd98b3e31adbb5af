import json
import re

from pyspark.sql import functions as F

from transcriptlab.functions import texts as X
from transcriptlab.operators import selection
from transcriptlab.plans.selection import QUERIES
from transcriptlab.sources import intake, views

DATA = "/root/testdata/sf0.001"


def each(spark, column, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    return [r[0] for r in rows.orderBy("n").select(column(F.col("x"))).collect()]


def test_cleaning(spark):
    assert each(spark, X.plain_spacing, ["WEBVTT 00:00:01.5 --> 00:00:02.0 <v Bo>hi</v>  [music] you\n\n\n\nx ", None]) == ["hi you\n\nx", ""]
    assert each(spark, X.caption_text, ["<i>a</i> [laughs]\n b ♪ la ♪", None]) == ["a b", ""]
    assert each(spark, X.without_markers, ["<|en|>hello<|end|>"]) == ["hello"]
    assert each(spark, X.spoken_form, ["I don't; it isn’t, won't! thirty-three", None]) == ["i do not it is not will not 30 3", ""]
    assert each(spark, X.fallback_reason, ["x|fallback_reason= slow |y", "x", None]) == ["slow", "", ""]
    assert each(spark, X.url_class, ["http://localhost:1", "http://a", None]) == ["loopback", "other", "other"]
    assert each(spark, lambda c: X.replace_words(c, {"a.b": "X$1", "rumble fix": "Y"}), ["Rumble  fix rumble FIX a.b, aab xa.b"]) == ["Rumble  fix Y X$1, aab xa.b"]
    assert each(spark, lambda c: X.effective_text(F.lit(" "), c, F.lit("z")), ["y ", None]) == ["y", "z"]
    assert each(spark, X.no_speech, ["[BLANK_AUDIO]", "(no  speech)", "<|nospeech|>", "music room", None]) == [True, True, True, False, True]
    assert each(spark, X.script_class, ["abc", "नमस्ते", "ok नमस्ते", "12", None]) == ["latin", "devanagari", "mixed", "other", "other"]


def test_seams(spark):
    parts = [["We will meet", "will MEET at noon", "", "noon", "at noon today"], [], None]
    assert each(spark, X.join_overlapping, parts, "array<string>") == ["We will meet at noon today", "", None]


def test_reasons(spark):
    ask = lambda d, f, t=1.0: spark.range(1).select(X.update_reasons(F.lit(d), F.lit(f), F.lit(t), 2.0)).first()[0]
    assert ask("use the API", "use the api") == []
    assert ask("use the API and MCPs", "use it", 3.0) == ["tail>threshold", "protected-term-missing:api,mcp"]
    assert ask("GitHub", "GitHub SSH no no no") == ["repetition", "protected-term-new:ssh"]
    assert ask(None, None) == ["empty-final"]


def blocks(text):
    """The reference answer for repetition, by plain regular expressions and loops."""
    words, letters = re.findall(r"\w+", text.lower()), re.sub("[^a-z]+", "", text.lower())
    best = 0.0
    for z in range(2, min(8, len(words) // 3) + 1) if len(words) >= 8 else ():
        for i in range(len(words) - 3 * z + 1):
            n = 1
            while words[i + n * z : i + (n + 1) * z] == words[i : i + z]:
                n += 1
            best = max(best, z * n / len(words) if n >= 3 else 0.0)
    best = round(best, 3)
    if len(letters) >= 24:
        best = max([best] + [len(m.group(0)) / len(letters) for z in range(3, 16) for m in re.finditer(rf"([a-z]{{{z}}})\1{{2,}}", letters)])
    return round(best, 3)


def test_degenerate_against_brute_force(spark):
    rows = views.runs(spark, DATA).select("doc_id", "backend", "actual").collect()
    got = {(r["doc_id"], r["backend"]): (r["repeat"], r["degenerate"]) for r in QUERIES["degenerate_runs"](spark, DATA).collect()}
    want = {(r["doc_id"], r["backend"]): (blocks(r["actual"] * 3), not r["actual"].strip() or blocks(r["actual"]) >= 0.25) for r in rows}
    assert got == want
    assert each(spark, X.repeated_substring_score, ["abcabcabcabcabcabcabcabc x", "go on go on go on go on", "", None]) == [round(24 / 25, 3), 1.0, 0.0, 0.0]


def test_choices_on_odd_rows(spark):
    schema = "id string, name string, place int, text string, error string"
    rows = [("a", "x", 0, "[noise]", None), ("a", "y", 1, "fine words", None), ("b", "x", 0, None, None), ("c", "x", 0, "late", "timeout")]
    got = {tuple(r) for r in selection.first_usable(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "y", "fine words", False), ("b", "none", "", True), ("c", "x", "late", True)}
    assert selection.first_usable(spark.createDataFrame([], schema)).count() == 0
    claims = spark.createDataFrame([("1", "m", "s", 0.5), ("2", "m", "t", 0.5), ("3", "m", "u", 0.5), ("4", "m", "v", 0.5)], "claim_id string, metric string, selector string, expected double")
    facts = spark.createDataFrame([("s", "m", 0.5004), ("t", "m", None), ("u", "m", 0.5), ("u", "m", 0.5)], "selector string, metric string, value double")
    assert {r[0]: r[2] for r in selection.audit_claims(claims, facts).collect()} == {"1": "ok", "2": "off", "3": "ambiguous", "4": "missing"}


def test_readers(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return str(path)

    captions = {"events": [{"tStartMs": 1000, "dDurationMs": 500, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 5}, {"segs": [{"utf8": "x"}]}]}
    assert [tuple(r)[1:] for r in intake.read_captions(spark, put("c.json", json.dumps(captions))).collect()] == [(1.0, 1.5, "a b")]
    metrics = [{"evt": "conversationalReply", "eid": 7, "mic_audio_b64": "YWI=", "heard": " hi "}, {"evt": "conversationalReply"}, {"evt": "other", "mic_audio_b64": "YQ=="}]
    got = intake.read_session_metrics(spark, put("ludo_1.json", json.dumps(metrics))).collect()
    assert [(r["id"], r["heard"], bytes(r["audio"]), r["mime"]) for r in got] == [("ludo_1__7", "hi", b"ab", "audio/webm")]
    for n, shape in enumerate([[{"id": "1"}], {"rows": [{"id": "2"}]}, {"items": [{"id": "3"}]}, {}]):
        put(f"rows/{n}.json", json.dumps(shape))
    assert sorted(r["id"] for r in intake.read_rows(spark, str(tmp_path / "rows")).collect()) == ["1", "2", "3"]
    put("k/d/text", "u1 hello there\nu1 again\nu2 bye\nu3\n")
    put("k/d/segments", "u1 r1 0.5 1.5\nu2 r2 x 3\n")
    put("k/d/wav.scp", "r1 a.wav\nr2 sox b |\nu2 c.wav\n")
    got = sorted(tuple(r) for r in intake.read_utterances(spark, str(tmp_path / "k")).collect())
    assert got == [("u1", "hello there", "r1", 0.5, 1.5, "a.wav"), ("u2", "bye", "u2", None, None, "c.wav")]


def test_intake(spark, tmp_path):
    events = spark.createDataFrame([(" site viewed ", "s1", "{x}", None), ("other", "s", "t", "/"), (None, None, None, None)], "event string, session string, target string, location string")
    assert [tuple(r) for r in intake.clean_web_events(events).collect()] == [("site viewed", "s1", "unknown", "/")]
    schema = "source string, replacement string, enabled boolean, approved boolean, note string"
    base = spark.createDataFrame([("Rumble Fix", "old", False, True, "n"), ("keep", "kept", None, True, "n"), ("bad", "x", True, None, "n")], schema)
    delta = spark.createDataFrame([("rumble  fix", "New", "why"), ("same", "SAME", "n"), ("q", "r", " "), (None, "r", "n"), ("z" * 121, "r", "n")], "source string, replacement string, note string")
    assert sorted(filter(None, (r["problem"] for r in intake.check_fixes(delta).collect()))) == ["empty", "long", "no note", "same"]
    merged = intake.upsert_fixes(base, delta)
    assert {tuple(r) for r in intake.phrase_fixes(merged).collect()} == {("rumble fix", "New"), ("keep", "kept")}
    clips = spark.createDataFrame([("a", "old", "w"), ("b", "kept", "w")], "id string, gold string, workflow string")
    review = spark.createDataFrame([("a", "new", "en"), ("c", "more", "en")], "id string, gold string, language string")
    assert {tuple(r) for r in intake.merge_review(clips, review).collect()} == {("a", "new", "w"), ("b", "kept", "w"), ("c", "more", None)}
    words = spark.createDataFrame([("MCP", ["b", "a"]), ("API", None)], "canonical string, aliases array<string>")
    assert intake.dictionary_version(words).first()[0] == intake.dictionary_version(words.orderBy("canonical")).first()[0] != intake.dictionary_version(words.limit(1)).first()[0]
    assert [r["id"] for r in intake.intake_rows(spark.createDataFrame([("p", "t")], "prompt_id string, text string"), ("en", "hi")).collect()] == ["p_01", "p_02"]
    rows = spark.createDataFrame([("a", "confirmed"), ("b", "review")], "id string, status string")
    intake.split_confirmed(rows, str(tmp_path / "all"), str(tmp_path / "good"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["a"] and spark.read.parquet(str(tmp_path / "all")).count() == 2
