import hashlib
import re
import time
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.llm import ann, chat, html, linedup, mixing, neardup, packing, queries, secrets, topk, toxicity, vectors
from transcriptlab.llm.common import stash, table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, tid string, size string"
#: Names that operators use themselves.
CLASHES = "_drop _h _k _host _line _key _again _doc _id _copies row host gone key salt id again own own_key copies copy taken text_key class_id n_lines n_dropped label bucket bands score ids draw toxic piece words spans _text _own s e kind q query_id pivot rid".split()
LONG = "word " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in rows], DOCS)


def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, columns whose names the operators use themselves."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "a"), (1, words, "a"), (2, words + " more", "a"), (3, None, None), (4, "", "b"), (5, " \n ", "b"), (None, "alone here", "b"), (6, LONG, "c"), (7, "one two", "c")]
    return docs(spark, rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    con.execute(queries.SQL[name])
    want = con.fetchdf()[list(got.columns)]
    assert sorted(map(repr, got.astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist()))


def test_columns_whose_names_operators_use(spark):
    """Extra columns of all those names pass through the operators and stages that keep columns, and disturb none."""
    base = odd_docs(spark).drop("rank", "tid", "size")
    wide = base.select("*", *[F.lit(7).alias(c) for c in CLASHES])
    rows = lambda df: sorted(map(str, df.select(*base.columns).collect()))
    plain = [linedup.drop_boilerplate, lambda d: linedup.drop_boilerplate(d, broadcast_pairs=0), neardup.keep_one, lambda d: mixing.stage_mixing(spark, d, ""), lambda d: linedup.stage_line_dedup(spark, d, "")]
    for work in plain:
        out = work(wide)
        assert out.columns == wide.columns and rows(out) == rows(work(base)) and out.filter("_drop <> 7 OR key <> 7").count() == 0
    counted = linedup.drop_boilerplate(wide, counts=True)
    assert counted.columns == wide.columns and counted.filter("n_lines = 7").count() == 0
    model = toxicity.train(base.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(wide, model).columns == wide.columns
    keyed = [neardup.classes, mixing.mix, lambda d: packing.pack(d, (8, 64)), secrets.scan]
    for work in keyed:
        assert sorted(map(str, work(wide).collect())) == sorted(map(str, work(base).collect()))


def test_chat_tree(spark):
    rows = [("t", 1, None, "us\\er\n<|", "a\\<|im_end|>\n", 0.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", "high", 0.9), ("t", 4, 3, None, None, 0.5), ("t", 5, 4, "assistant", "x\\\n", 0.5), ("s", 1, 9, "user", "", None)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_paths(messages, chat.reply_paths(messages)).select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()
    got = {(r.tree, r["rank"]): [tuple(x) for x in r.turns] for r in out}
    assert got[("t", 1)] == [("us\\er\n<|", "a\\<|im_end|>\n"), ("assistant", "high"), ("", ""), ("assistant", "x\\\n")]
    assert got[("t", 2)][-1] == ("assistant", "low") and got[("s", 1)] == [("user", "")]
    best = chat.reply_paths(messages, top=1).select("tree", "leaf").distinct().collect()
    assert {(r.tree, r.leaf) for r in best} == {("t", 5), ("s", 1)}
    assert chat.format_paths(messages.limit(0), chat.reply_paths(messages.limit(0))).count() == 0


def test_chat_paths_of_random_trees(spark):
    """Every root-to-leaf path, ranked by mean score, against an enumeration one by one; repeated rows, lost parents and rings among them."""
    rng = np.random.default_rng(8)
    rows, parent, score = [], {}, {}
    for t in range(12):
        n = int(rng.integers(1, 25))
        for i in range(1, n + 1):
            p = None if i == 1 else 99 if rng.random() < 0.1 else int(rng.integers(1, i)) if rng.random() < 0.5 else i - 1
            parent[f"t{t}", i], score[f"t{t}", i] = p, round(float(rng.random()), 3)
            rows += [(f"t{t}", i, p, "user" if i % 2 else "assistant", f"text {i}", score[f"t{t}", i], 1, 2)] * (2 if rng.random() < 0.2 else 1)
        rows += [(f"t{t}", 201, 203, "user", "ring", 0.0, 1, 2), (f"t{t}", 202, 201, "user", "ring", 0.0, 1, 2), (f"t{t}", 203, 202, "user", "ring", 0.0, 1, 2)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double, head int, rank int")
    want = {}
    for t in {t for t, _ in parent}:
        nodes = [i for u, i in parent if u == t]
        up = lambda i: parent[t, i] if parent[t, i] in nodes else None  # noqa: E731, B023
        paths = []
        for leaf in nodes:
            if not any(up(i) == leaf for i in nodes):
                path, at = [], leaf
                while at is not None:
                    path.insert(0, at)
                    at = up(at)
                paths.append((-sum(score[t, i] for i in path) / len(path), leaf, path))
        want[t] = [p for _, _, p in sorted(paths)]
    for top in (None, 1, 3):
        got = defaultdict(dict)
        for r in chat.reply_paths(messages, top).orderBy("position").collect():
            got[r.tree].setdefault(r["rank"], []).append(r.node)
        assert {t: [v[k] for k in sorted(v)] for t, v in got.items()} == {t: v[:top] for t, v in want.items()}
    formatted = chat.format_paths(messages, chat.reply_paths(messages, 1)).select("tree", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert {r.tree: [x.text for x in r.turns] for r in formatted} == {t: [f"text {i}" for i in v[0]] for t, v in want.items()}


def test_chat_of_odd_conversations(spark, tmp_path):
    rows = [(None, 0, "user", "no id"), (5, 1, None, None), (5, 1, None, None), (5, None, "assistant", "last"), (5, 0, "assistant", "b"), (5, 0, "assistant", "a"), (6, 0, "assistant", LONG)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op1_chat(spark, str(tmp_path)).collect()}
    said = "".join(f"{role}\n{text}\n" for role, text in (("assistant", "a"), ("assistant", "b"), ("", ""), ("", ""), ("assistant", "last")))
    assert got.keys() == {None, 5, 6, -1} and got[5].n_turns == 5 and got[5].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[5].loss_sha256 == hashlib.sha256(b"ablast").hexdigest() and got[6].loss_chars == len(LONG) and got[-1].n_turns == 2
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert [r.conv_id for r in chat.op1_chat(spark, f"{tmp_path}/empty").collect()] == [-1]


def test_packing(spark):
    def check(rows, lengths):
        for _, bin_rows in rows.items():
            bin_rows.sort(key=lambda r: r.start)
            at = 0
            for r in bin_rows:
                assert r.start == at
                at += r["size"]
            assert at == bin_rows[0].bin_used and bin_rows[0].bin_length == min(x for x in lengths if x >= at)

    out = packing.pack(odd_docs(spark), (8, 16, 64)).collect()
    assert Counter(r.doc_id for r in out)[6] == -(-30_000 // 64)
    assert sum(r["size"] for r in out) == 40 * 2 + 41 + 2 + 2 + 30_000
    assert all(r.bin_id is None for r in out if r["size"] == 0)
    bins = defaultdict(list)
    for r in out:
        if r["size"]:
            bins[r.bin_id].append(r)
    check(bins, (8, 16, 64))
    assert packing.pack(odd_docs(spark).limit(0)).count() == 0


def test_packing_is_best_fit(spark):
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 60, 400).tolist(), reverse=True)
    rooms = []  # one by one, with a single length
    for s in sizes:
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(64 - s)
    _, _, bins = packing.plan(Counter(sizes), (64,))
    used = sorted(u for u, n in zip(bins["used"].tolist(), bins["count"].tolist(), strict=True) for _ in range(n))
    assert used == sorted(64 - r for r in rooms)


@pytest.mark.parametrize("seed", range(4))
def test_packing_chooses_the_cheapest_set_of_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = (16, 24, 40, 64)
    histogram = Counter(rng.integers(1, 65, 300).tolist() if seed % 2 else np.minimum(rng.geometric(0.08, 300), 64).tolist())
    cost = (lambda n: float(n)) if seed < 2 else packing.default_cost
    total, slots, bins = packing.best_plan(histogram, lengths, cost)
    options = []
    for k in range(len(lengths)):
        for some in combinations(lengths[:-1], k):
            _, _, b = packing.plan(histogram, (*some, lengths[-1]), cost)
            options.append(sum(n * cost(min(x for x in lengths if x >= u)) for u, n in zip(b["used"].tolist(), b["count"].tolist(), strict=True)))
    assert abs(total - min(options)) < 1e-6 and len(set(options)) > 1
    # every word has a place, no bin is over its length, and each is as short as its contents allow
    assert sum(s * n for s, n in histogram.items()) == int((bins["used"] * bins["count"]).sum())
    assert all(length == min(x for x in lengths if x >= used) for length, used in zip(bins["length"].tolist(), bins["used"].tolist(), strict=True))


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(1000, None, "s0"), (1001, "", "none")]
    data = docs(spark, rows)
    out = mixing.mix(data, block=8).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:  # reshare again and again
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            full.add(s)
            target[s] = 3.0 * sizes[s]
            left -= target[s]
    taken = Counter()
    for r in out:
        assert r.taken <= 3 * r["size"] and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 16 for s in names)
    again = mixing.mix(data.repartition(3), block=8).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(data.limit(0)).count() == 0 and all(r.taken == 0 for r in mixing.mix(data.filter("size = 'y' AND doc_id >= 1000")).collect())


def test_mixing_of_odd_rows(spark):
    """Repeated rows, a null id, null and empty texts and a very long one: each row has its own line of the answer."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (2, None, "x"), (3, "", "y"), (4, LONG, "y"), (5, "f", None)]
    out = mixing.mix(docs(spark, rows), block=8).collect()
    assert len(out) == len(rows) and sum(r["size"] for r in out) == 3 + 3 + 2 + 30_000 + 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in out) and {r["size"] for r in out if r.doc_id in (2, 3)} == {0}
    assert len([r for r in out if r.doc_id is None]) == 1 and all(r.target <= 3 * r.source_size + 1e-9 for r in out)


def jaccard(a, b):
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    a, b = cut(a.split()), cut(b.split())
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def test_near_dedup(spark):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 120)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 5, 9):
            t = list(b)
            for p in rng.integers(0, 120, edits):
                t[p] = f"z{rng.integers(0, 9999)}"
            texts.append(" ".join(t))
    hub = [f"h{x}" for x in range(200)]
    texts += [" ".join([f"e{i}-{j}" if (j * 37 + i * 11) % 90 == 0 else w for j, w in enumerate(hub)]) for i in range(150)] + [" ".join(hub)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "", "a"), (902, " \n", "a"), (903, texts[0], "b"), (None, texts[1], "b"), (904, "a b", "b"), (904, "a b", "b"), (905, LONG, "b")]
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, rows)).collect()}
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    first = {}
    for (i, _, _), x in zip(rows, label, strict=True):
        if i is not None:
            first[x] = min(first.get(x, i), i)
    assert got == {i: first.get(x) for (i, _, _), x in zip(rows, label, strict=True)}
    kept = neardup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert neardup.classes(docs(spark, rows).limit(0)).count() == 0


def test_near_dedup_of_texts_that_differ_in_how_often_a_passage_repeats(spark):
    rows = []
    for g in range(12):
        single, passage = " ".join(f"s{g}-{i}" for i in range(60)), " ".join(f"p{g}-{i}" for i in range(14))
        # the passage follows itself in both, so that the sets of shingles are the same
        rows += [(2 * g, f"{single} {passage} {passage}", "a"), (2 * g + 1, f"{single} " + " ".join([passage] * 500), "a")]
    got = {r.doc_id: r.class_id for r in neardup.classes(docs(spark, rows)).collect()}
    assert all(jaccard(rows[2 * g][1], rows[2 * g + 1][1]) == 1.0 for g in range(12)) and got == {i: i // 2 * 2 for i in range(24)}


def test_near_dedup_blocks_compare_every_pair(spark):
    rng = np.random.default_rng(4)
    of = [np.unique(rng.integers(0, 9, 12) + 9 * (i % 4)).astype(np.uint64) for i in range(40)] + [np.zeros(0, np.uint64)] * 2
    times = [rng.integers(1, 4, len(x)).astype(np.int32) if i % 3 == 0 else np.zeros(0, np.int32) for i, x in enumerate(of)]
    sets = spark.createDataFrame([(i, bytearray(x.tobytes()), bytearray(c.tobytes())) for i, (x, c) in enumerate(zip(of, times, strict=True))], "tid long, set binary, counts binary")
    large = spark.createDataFrame([(7, i, 600, i) for i in range(len(of))], "bucket long, tid long, n long, label long")
    got = {r.tid: r.label for r in neardup.components(neardup._blocks(large, sets, 0.8)).collect()}
    label = list(range(len(of)))
    for i in range(len(of)):
        for j in range(i):
            if label[i] != label[j] and neardup.similarity_of((of[i], times[i]), (of[j], times[j])) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {i: got.get(i, i) for i in range(len(of))} == dict(enumerate(label))


def test_signatures_estimate_similarity():
    import pyarrow as pa

    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(60, 460))
    sig = neardup.signatures(pa.array([a, b, "one two", ""]), 2000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 0.04
    alone = neardup.signatures(pa.array([b]), 2000)
    assert (alone[0] == sig[1]).all() and (sig[3] == 0).all() and (sig[2] > 0).all()


def test_secrets(spark):
    hexes, key = "0123456789abcdef01234567", "AKIA" + "Z" * 16
    texts = [(1, f"é𝄞 Token = \"abcdef\" and {key}", "a"), (2, "secret=token:abcdefgh password: short api_key=abc", "a"), (3, f"apikey:{hexes} 0123456789abcdef", "a"), (4, "-----BEGIN RSA PRIVATE KEY-----", "a"), (5, None, "a"), (None, f"x{hexes}", "a"), (6, LONG + f"passwd={hexes}", "a")]
    out = {r.doc_id: r for r in secrets.scan(docs(spark, texts), keep=("rank",)).collect()}
    for i, t, _ in texts:
        want = []
        for kind, rule in ((r.kind, r) for r in secrets.RULES):
            for m in re.finditer(rule.regex.replace("(?i:", "(?i:"), t or ""):
                if len(m[rule.group]) >= rule.least:
                    want.append((m.start(), [r.kind for r in secrets.RULES].index(kind), m.end(), kind))
        assert [tuple(x) for x in out[i].spans] == sorted(want)
    assert [x.kind for x in out[1].spans] == ["assign", "access"] and out[5].spans == []
    assert secrets.scan(docs(spark, texts).limit(0)).count() == 0
    assert secrets.trigram_query(secrets.HEX) == []
    # beyond the bound of what is broadcast
    far = secrets.scan(docs(spark, texts), keep=("rank",), broadcast_keys=0).collect()
    assert sorted(map(str, far)) == sorted(map(str, out.values()))
    twice = docs(spark, [*texts, texts[0]])
    assert sorted(map(str, secrets.scan(twice).collect())) == sorted(map(str, secrets.scan(twice, broadcast_keys=0).collect()))


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert {*secrets.trigram_query("ab(c|de)?f")[0]} == {frozenset({"abc", "bcf"}), frozenset({"abd", "bde", "def"}), frozenset({"abf"})}
    assert secrets.trigram_query("gh[pousr]_[A-Z]{3}xyz") == [sorted([frozenset({f"gh{c}", f"h{c}_"}) for c in "pousr"], key=sorted), [frozenset({"xyz"})]]
    assert secrets.trigram_query("abc|x") == [] and secrets.trigram_query("(?:abc|abd)e*") == [[frozenset({"abc"}), frozenset({"abd"})]]
    # every match holds what the query asks for
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        for text in ("Api_Key: 'abcdef'", "passwd=x", "xx AKIA0123", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 40, "xoxb-" + "1" * 12, "AIza" + "b" * 35, "eyJ" + "c" * 9 + ".eyJ" + "d" * 9 + "." + "e" * 9):
            for m in re.finditer(rule.regex, text):
                assert all(any(all(t in m[0].lower() for t in s) for s in clause) for clause in query)


def test_line_dedup(spark):
    rows = [(i, f"menu\n own line {i}\n\n menu \nend", "a") for i in range(20)] + [(50, "menu\nx", "b"), (51, None, "a"), (52, "", "a"), (53, "menu", "a"), (54, "menu\nnull host", None)]
    small = {r.doc_id: r.text for r in linedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert small[3] == " own line 3\n" and small[50] == "menu\nx" and small[51] is None and small[52] == "" and small[53] == "" and small[54] == "menu\nnull host"
    large = {r.doc_id: r.text for r in linedup.drop_boilerplate(docs(spark, rows), broadcast_pairs=0).collect()}
    assert large == small and linedup.drop_boilerplate(docs(spark, rows).limit(0)).count() == 0


def test_line_dedup_takes_a_template_line_from_every_host(spark):
    # by host, the pages of 500 that hold a licence line, as chance spreads a tenth; a line on 4 % of the pages is the host's own
    held = {"a": 43, "b": 50, "c": 66}
    rows = [(i, f"own {i}\n" + "licence\n" * (i % 500 < held[s]) + "twentieth\n" * (480 <= i % 500), s) for s in held for i in range(500)]
    out = linedup.drop_boilerplate(docs(spark, rows)).groupBy("source").agg(F.sum(F.col("text").contains("licence").cast("int")).alias("kept"), F.sum(F.col("text").contains("twentieth").cast("int")).alias("clean")).collect()
    assert {r.source: (r.kept, r.clean) for r in out} == dict.fromkeys(held, (0, 20))


def vector_table(spark):
    """Rows (place, vec_id, vector or None) and the table; equal vectors, repeated ids and vectors of another length among them."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(i, [0.5] * 8) for i in range(600, 660)] + [(700, None), (701, [0.1, None] + [0.0] * 6), (702, [float("nan")] * 8), (703, [0.0] * 8), (None, [1.0] * 8), (704, []), (650, [0.5] * 8), (650, [0.25] * 8)]
    rows += [(800 + i, [0.25 * i, 1.0, -0.5]) for i in range(3)]
    table = spark.createDataFrame([(i, v, "extra", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score string, rid int, pivot int")
    known = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    return table, known


def best_of(known, every, k, score):
    """For each query row its (vec_id, score) list by brute force; rows that repeat a query's id give lists of their own."""
    out = defaultdict(list)
    for a, (q, x) in enumerate(known):
        if q % every == 0:
            found = [(-score(x, y), i, b) for b, (i, y) in enumerate(known) if b != a and len(y) == len(x)]
            out[q].append([(i, -s) for s, i, _ in sorted(found)[:k]])
    return {q: sorted(v) for q, v in out.items()}


def ranked(rows):
    """The same of an answer, where lists of one id can't be told apart but by their ranks."""
    out = defaultdict(lambda: defaultdict(list))
    for r in rows:
        out[r.query_id][r["rank"]].append((r.vec_id, r.score))
    return out


def test_top_k(spark):
    table, known = vector_table(spark)
    known = [(i, np.floor(v * 256)) for i, v in known]
    whole = vectors.vectors(table, zero=True).select("rid", "vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    want = best_of(known, 50, 5, lambda x, y: int(x @ y))
    for block_rows, shard_rows in ((5, 100), (2048, 8192)):
        got = ranked(topk.top_k(whole.filter("vec_id % 50 = 0"), whole, 5, block_rows, shard_rows).collect())
        assert got.keys() == want.keys() and 800 in got and len(want[650]) == 3
        for q, lists in want.items():
            for rank in range(max(map(len, lists))):
                assert sorted(got[q][rank + 1]) == sorted(x[rank] for x in lists if rank < len(x))
    assert topk.top_k(whole.limit(0), whole, 5).count() == 0 and topk.top_k(whole, whole.limit(0), 5).count() == 0


def test_neighbours(spark):
    table, known = vector_table(spark)
    known = [(i, v) for i, v in known if v.any()]
    data = vectors.vectors(table, zero=False)
    distance = lambda x, y: float(np.sqrt(((x - y) ** 2).sum()))
    want = best_of(known, 100, 10, lambda x, y: -distance(x, y))
    of = defaultdict(list)
    for i, v in known:
        of[i].append(v)
    for factor, least in ((1.0, 1.0), (ann.FACTOR, 0.9)):
        got = ranked(ann.neighbours(data.filter("vec_id % 100 = 0"), data, 10, factor, block_rows=5, shard_rows=200).collect())
        assert got.keys() == want.keys()
        hits = 0
        for q, (x,) in ((q, of[q]) for q in want):
            mine = [got[q][r + 1][0] for r in range(len(got[q]))]
            # scores are exactly the measure, best first, ties to smaller ids
            assert all(any(abs(s - distance(x, y)) < 1e-12 for y in of[i]) for i, s in mine) and mine == sorted(mine, key=lambda m: (m[1], m[0]))
            hits += len({i for i, _ in mine} & {i for i, _ in want[q][0]})
            assert factor > 1 or [i for i, _ in mine] == [i for i, _ in want[q][0]]
        assert hits >= least * sum(len(v[0]) for v in want.values())


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.floor((rng.normal(0, 1, (20, 16))[rng.integers(0, 20, n)] + rng.normal(0, 0.1, (n, 16))) * 64)


@pytest.mark.parametrize("n", [1000, 2000, 6000])
def test_cover_trees_prune(n):
    x, ids = clustered(n), np.arange(n)
    tree, own, seen = topk.cover_tree(x), np.arange(0, n, 50), []
    topk.dual_search(tree, x, ids, ids, x[own], own, 5, np.full(len(own), -np.inf), seen)
    assert seen[0] < 0.35 * len(own) * n
    # the covering rule: every node holds its points, and centres of siblings are apart by more than its radius / BASE
    for i in range(len(tree.radius)):
        points = tree.order[tree.start[i] : tree.stop[i]]
        assert (np.linalg.norm(x[points] - tree.centre[i], axis=1) <= tree.radius[i]).all()
        kids = tree.centre[tree.kids[i] : tree.last[i]]
        if len(kids) > 1:
            apart = np.linalg.norm(kids[:, None] - kids[None], axis=2)[np.triu_indices(len(kids), 1)]
            assert apart.min() >= np.linalg.norm(x[points] - tree.centre[i], axis=1).max() / topk.BASE - 1e-6


@pytest.mark.parametrize("n", [1000, 2000, 6000])
def test_vantage_trees_prune_and_the_factor_prunes_more(n):
    x, ids = clustered(n), np.arange(n)
    tree, own, shares = ann.vantage_tree(x), np.arange(0, n, 50), []
    for factor in (1.0, 2.0, ann.FACTOR, 20.0):
        seen = []
        ann.tree_search(tree, x, ids, ids, x[own], own, 10, np.full(len(own), -np.inf), factor, seen)
        shares.append(seen[0] / len(own) / n)
    assert shares[0] < 0.6 and shares == sorted(shares, reverse=True) and shares[3] < 0.7 * shares[0]


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class=site-header>Site</header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use the cookies of this site and that is it for you.</div><article><h1>Head &amp; line</h1><p>It was  the best\nof times &eacute;.<p>Short.
    <aside>See the other page of this site</aside><p>The end of it all was <a href=y>not</a> the end.</article><section id="comments"><p>I think that this was the best of all the pages that I have seen.</p></section>
    <form><p>Mail</p></form><script>var x = "<p>no</p>";</script><footer>The footer of the page &copy;</footer></body></html>"""
    rows = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (1, page, "t"), (4, "<p>" + "the text of it " * 40_000, "t")], "page_id long, html string, n_chars string")
    got = html.extract(rows).collect()
    assert [r.text for r in got if r.page_id == 1] == ["Head & line\nIt was the best of times é.\nShort.\nThe end of it all was not the end."] * 2
    assert {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.text for r in got}[3] == "" and len({r.page_id: r.text for r in got}[4]) == 15 * 40_000 - 1
    assert html.extract(rows.limit(0)).count() == 0 and html.extract(rows).columns == [*rows.columns, "text"]
    # a column of the new one's name is replaced
    clash = rows.withColumn("text", F.lit("old")).withColumn("n", F.lit(1))
    assert html.extract(clash).columns == clash.columns and html.extract(clash).filter("text = 'old'").count() == 0


ENGLISH, OTHER = "it is the text of that and this and so on " * 8, "bu bir metin olarak uzun uzun yazilmis cumle " * 8


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="side-by-side"><p>{ENGLISH}</p><p>The END.</p></div><nav><a href=x>x</a></nav>', f"{ENGLISH.strip()}\nThe END."),
        (f'<div class="layout sidebar-right"><p>{ENGLISH}</p><p>Short.</p></div><div class="sidebar"><p>{ENGLISH} more {ENGLISH}</p></div>', f"{ENGLISH.strip()}\nShort."),
        ('<div id="page" class="has-sidebar"><article><h1>Head</h1><p>One.</p></article></div>', "Head\nOne."),
        (f"<h1>Title</h1><p>{ENGLISH}</p><p>The END.</p><footer>Imprint</footer>", f"Title\n{ENGLISH.strip()}\nThe END."),
        (f"<h1>Title</h1><article><p>{ENGLISH}</p></article>", f"Title\n{ENGLISH.strip()}"),
        (f"<p>{OTHER}</p><p>{OTHER[:100]}</p><ul><li><a href=x>Link</a></li></ul>", f"{OTHER.strip()}\n{OTHER[:100].strip()}"),
        ('<article><header class="entry-header"><h1>Head</h1></header><p><a href=x>All of it a link</a></p><figure><figcaption>Caption</figcaption></figure><fieldset><p>Set</p></fieldset></article>', "Head\nAll of it a link\nCaption\nSet"),
        (f'<article><p>One.</p><section id="comments"><article class="comment"><p>{ENGLISH}</p></article></section><div class="social-share"><p>Share it</p></div></article>', "One."),
        (f'<div class="related-posts"><article><h2>Other</h2><p>{ENGLISH}</p></article></div><article><p>{ENGLISH}</p></article>', ENGLISH.strip()),
        (f'<div class="cookie-notice"><p>{ENGLISH}</p></div><p hidden>{ENGLISH}</p>', ""),
        (f"<p>{ENGLISH}</i></b></p></div></div><p>a &lt; b</p>", f"{ENGLISH.strip()}\na < b"),
    ],
)
def test_html_marks_are_evidence(page, want):
    assert html.main_text(page) == want


def test_html_of_all_pages(spark):
    """The article of every page: its markup off, tags parting blocks."""
    for r in html.extract(table(spark, DATA, "pages")).collect():
        inner = re.sub("<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in parts if x)


def test_html_time_grows_with_the_page():
    def took(n):
        began = time.perf_counter()
        html.main_text("<b>" * n + "x" + "</i>" * n + "<dt>" + "<b>" * n + "<dt></dt>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 40 * max(took(4_000), 0.01)


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        if i % 6 == 0:
            for p in rng.integers(0, 40, 2):
                words[p] = ("nasty", "awful", "rotten")[rng.integers(3)]
        rows.append((i, " ".join(words), "a"))
        marks.append((i, int(i % 6 == 0)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    data = docs(spark, [*rows, (900, None, "a"), (901, "", "a"), (None, LONG, "a")]).drop("rank")
    model = toxicity.train(data, labels)
    got = toxicity.score(data, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= 0.5, r.doc_id % 6 == 0) for r in got if r.doc_id is not None and r.held and r.doc_id < 600]
    assert np.mean([a == b for a, b in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got) and len(got) == 603
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    untrained = toxicity.train(data.limit(0), labels.limit(0))
    assert toxicity.score(data.limit(0), untrained).count() == 0


def test_toxicity_trains_once_on_repeated_rows_and_within_its_words(spark, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 5} " + ("nasty" if i % 3 == 0 else "kind"), "a") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    again = next(i for i, in docs(spark, rows).filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id").orderBy("doc_id").collect())
    data = docs(spark, [*rows, *[rows[again]] * 500]).drop("rank")
    seen, agreement = [], toxicity.agreement

    def spy(ids, toxic, size):
        seen.append([len(x) for x in ids])
        return agreement(ids, toxic, size)

    monkeypatch.setattr(toxicity, "agreement", spy)
    one, repeated = (toxicity.train(d, labels, toxicity.Config(steps=1)) for d in (docs(spark, rows), data))
    assert len(seen[0]) == len(seen[1]) <= 200 and np.array_equal(one.embedding, repeated.embedding)
    # a doc_id whose different texts alone pass the bound leaves room for the others
    wide = docs(spark, [*rows, *[(again, f"x{i} y z", "a") for i in range(300)]])
    toxicity.train(wide, labels, toxicity.Config(steps=1, sample_words=800))
    assert len(seen[2]) == len(seen[0]) - 1 and sum(seen[2]) <= 800


def test_pipeline_stages_against_brute_force(spark):
    """Each stage over all rows that the one before kept, held against plain Python."""
    import corpus_pipeline

    before = table(spark, DATA, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stash(stage(spark, before, DATA))
        kept[name] = (before.collect(), after.collect())
        before = after
    rows, out = kept["toxicity"]
    rejected = {r.doc_id for r in toxicity.op10_toxicity(spark, DATA).collect() if r.flagged}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows if r.doc_id not in rejected)
    rows, out = kept["line dedup"]
    pages, held = Counter(r.source for r in rows), Counter((r.source, x) for r in rows for x in {y.strip(" ") for y in (r.text or "").split("\n")} if x)
    drop = {k for k, n in held.items() if n >= linedup.MIN_PAGES and n > linedup.RATIO * pages[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in drop) for r in rows}
    assert {r.doc_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
    rows, out = kept["near dedup"]
    cut = {r.doc_id: frozenset(zip(*[r.text.split()[i:] for i in range(5)], strict=False)) if len(r.text.split()) >= 5 else frozenset([tuple(r.text.split())]) if r.text.split() else frozenset() for r in rows}
    label = {i: i for i in cut}
    for i, j in combinations(sorted(cut), 2):
        a, b = cut[i], cut[j]
        if label[i] != label[j] and (a == b or (a and b and len(a & b) >= 0.8 * len(a | b))):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    assert sorted(r.doc_id for r in out) == sorted(set(label.values()))
    rows, out = kept["mixing"]
    times = {r.doc_id: round(r.taken / r["size"]) if r["size"] else 0 for r in mixing.mix(spark.createDataFrame(rows)).collect()}
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in times.items() if n})
    rows, out = kept["packing"]
    assert sum(r["size"] for r in out) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows) and all(r["size"] <= max(packing.LENGTHS) for r in out)


def test_pipeline(spark):
    import corpus_pipeline

    current, columns = table(spark, DATA, "documents"), None
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, DATA)
        if name != "packing":
            assert current.columns == columns
        current = current.cache()
        assert current.count() > 0
    assert {"doc_id", "piece", "size", "bin_id"} <= set(current.columns)
    assert hashlib.sha256(str(sorted(map(str, corpus_pipeline.run(spark, DATA).collect()))).encode()).hexdigest() == hashlib.sha256(str(sorted(map(str, current.collect()))).encode()).hexdigest()
