"""Piece codec, chat formatting and the pipeline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.llm import chat_format as cf, piece_codec as pcod
from kmerloom.llm.queries import queries

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def codec():
    return pcod.Codec(open(pcod.MODEL, "rb").read())


def scan(codec, text, chunk):
    norm = pcod.BLANK + text.replace(" ", pcod.BLANK)
    end = len(norm)
    ms = []
    for k in range((end - 1) // chunk + 1):
        lo = max(0, k * chunk - 64)
        ms.append(pcod.unpack(pcod.pack(codec.transfer(norm[lo : lo + chunk + 128], lo, k * chunk, min(end, (k + 1) * chunk), end))))
    cut = pcod.cuts(ms, end)
    return [i for a, b in zip(cut, cut[1:]) for i in codec.fragment(norm[a:b])], ms


@pytest.mark.parametrize("chunk", [1, 5, 17, 64])
def test_scan_is_the_librarys_encoding(codec, chunk):
    rnd = random.Random(chunk)
    cases = [
        "a" * 200, " " * 100, "\n\n  \t x", "日本語テキスト 😀😀 ok", "aaaa bbbb" * 20, "The thing, then; another 12345.",
        "".join(rnd.choice("ab \n.é") for _ in range(300)), "".join(rnd.choice("    thein") for _ in range(300)), "".join(chr(rnd.randint(32, 0x2500)) for _ in range(200)),
    ]
    for t in cases:
        assert scan(codec, t, chunk)[0] == codec.encode([t])[0]


def test_combine_is_associative(codec):
    ms = scan(codec, "several words in a row, then some more of them", 9)[1]
    a, b, c = ms[:3]
    assert pcod.combine(pcod.combine(a, b), c) == pcod.combine(a, pcod.combine(b, c))


def test_encode_and_decode(spark, codec, data):
    rows = [(1, None, ""), (2, "", ""), (3, "x  y\n", ""), (None, "null id", ""), (4, "word " * 3000, ""), (4, "word " * 3000, ""), (5, "with ▁ itself " * 40, ""), (6, "😀é\n word" * 100, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pcod.encode(docs, chunk=200)
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert got.count() == len(rows)
    for i, t, _ in rows:
        want = codec.encode([t or ""])[0]
        assert by[i, len(want)].token_ids == want and by[i, len(want)].round_trip == ("▁" not in (t or ""))
    back = {r.doc_id: r.text for r in pcod.decode(got).collect()}
    assert back[1] == "" and back[3] == "x  y\n" and back[4] == "word " * 3000
    assert pcod.encode(docs.limit(0)).count() == 0
    table = spark.read.parquet(f"{data}/documents.parquet")
    whole = pcod.encode(table, chunk=3000)
    assert whole.filter("NOT round_trip").count() == 0
    texts = {r.doc_id: r.text for r in table.collect()}
    assert all(r.token_ids == codec.encode([texts[r.doc_id]])[0] for r in whole.collect())


@pytest.mark.parametrize("chunk, fan", [(64, 2), (64, 3), (200, 16)])
def test_tree_of_products_gives_the_librarys_encoding(spark, codec, chunk, fan):
    texts = {1: "The thing, then; another 12345. " * 40, 2: "a" * 700, 3: "😀é\n word" * 60, 4: " " * 300, 5: "short", 6: "word ▁ " * 50}
    docs = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in pcod.encode(docs, chunk=chunk, fan=fan).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert got[i].token_ids == codec.encode([t])[0] and got[i].round_trip == ("▁" not in t)


def test_trace_follows_the_matrices(codec):
    norm = pcod.BLANK + "several words in a row, 😀 then some more of them".replace(" ", pcod.BLANK)
    end, chunk = len(norm), 9
    spans = [(p, min(end, p + chunk)) for p in range(0, end, chunk)]
    ms = [codec.transfer(norm, 0, p, q, end) for p, q in spans]
    states = pcod.between(ms, (0, ""), pcod.only_end(pcod.functools.reduce(pcod.combine, ms), end))
    ids = [codec.trace(norm, 0, p, q, end, a, b) for (p, q), a, b in zip(spans, states, states[1:])]
    assert sum(ids, []) == codec.fragment(norm)
    assert pcod.between(ms, (0, ""), (end, "no piece")) is None and pcod.cuts([{}], 3) is None


def test_texts_without_one_path_are_encoded_as_one(spark, codec, monkeypatch):
    monkeypatch.setattr(pcod, "only_end", lambda m, end: None)
    texts = {1: "words and words " * 30, 2: "with ▁ itself " * 40, 3: "\n  x" * 90}
    docs = spark.createDataFrame([(i, t, "") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r for r in pcod.encode(docs, chunk=100).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert got[i].token_ids == codec.encode([t])[0] and got[i].round_trip == ("▁" not in t)



def test_schema_violations():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}, "maxItems": 1}, "c": {"type": "string", "pattern": "^q", "maxLength": 2}}}
    assert cf.violations({"a": 1}, s) == [] and cf.violations({"a": None, "b": ["x"], "c": "q"}, s) == []
    assert cf.violations({}, s) == ["$.a: required"] and cf.violations([], s) == ["$: type"] and cf.violations({"a": True}, s) == ["$.a: type"]
    assert cf.violations({"a": 0, "b": ["y", "x"], "c": "zzz", "d": 1}, s) == ["$.a: minimum", "$.b: maxItems", "$.b[0]: enum", "$.c: maxLength", "$.c: pattern", "$.d: additionalProperties"]


def test_linking(spark):
    calls = [
        (1, 1, "a", "t", '{"x": 1, "b": "é"}', ["b"]), (1, 2, "b", "t", None, []), (1, 3, "c", "t", "{bad", ["d"]), (1, 4, "d", "u", "{}", ["c"]),
        (2, 1, None, "t", "{}", None), (None, 1, "a", "t", '{"x": "no"}', ["gone"]),
    ]
    results = [(1, 9, "a", "second"), (1, 5, "a", "first"), (1, 6, "zz", "orphan"), (2, 1, None, "loose"), (3, 1, "a", None)]
    schemas = {"t": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    got = {r.conv_id: r for r in cf.link_tool_calls(spark.createDataFrame(calls, cf.CALL).withColumn("json", F.lit(1)), spark.createDataFrame(results, cf.RESULT), schemas).collect()}
    assert got.keys() == {1, 2, 3, None}
    r = got[1]
    assert (r.n_calls, r.n_linked, r.n_invalid, r.n_cyclic, r.n_orphans) == (4, 1, 2, 2, 1)
    steps = json.loads(r.json)["calls"]
    assert [s["call_id"] for s in steps] == ["b", "a", "c", "d"] and [x["content"] for x in steps[1]["results"]] == ["first", "second"]
    assert r.json == cf.canonical(json.loads(r.json)) and "é" in r.json
    assert (got[2].n_orphans, got[2].n_linked, got[3].n_calls, got[3].n_orphans, got[None].n_invalid) == (1, 0, 0, 1, 1)
    empty = cf.link_tool_calls(spark.createDataFrame([], cf.CALL), spark.createDataFrame([], cf.RESULT), schemas)
    assert empty.count() == 0


def test_odd_arguments_are_reported(spark):
    odd = ["[" * 100_000 + "]" * 100_000, "[" * 500 + "]" * 500, '{"x": "\\ud800"}', '{"\\udc00": 1}', "1e999", "NaN", '{"x": "' + "long " * 100_000 + '"}', "9" * 5000, "", '{"x": 1, "x": 2}']
    calls = spark.createDataFrame([(7, i, str(i), "t", a, None) for i, a in enumerate(odd)], cf.CALL)
    r = cf.link_tool_calls(calls, spark.createDataFrame([(7, 1, "6", "done " * 100_000)], cf.RESULT), {"t": {"type": "object"}}).first()
    steps = json.loads(r.json)["calls"]
    assert [s["errors"] for s in steps] == [["$: nested too deeply"]] * 2 + [["$: half a surrogate pair"]] * 2 + [["$: not JSON"]] * 2 + [[], ["$: not JSON"], ["$: not JSON"], []]
    assert steps[2]["arguments"] == {"x": "\ufffd"} and steps[9]["arguments"] == {"x": 2} and r.n_linked == 1 and r.n_invalid == 8


def test_linking_is_brute_force(spark):
    """Random calls and results against a nested loop."""
    rnd = random.Random(5)
    convs = [1, 2, 3, None, 0, -(2**63)]
    calls = [(rnd.choice(convs), rnd.randint(0, 9), rnd.choice([None, "a", "b", "c", "d"]), "t", rnd.choice(["{}", "[]", "{"]), [rnd.choice("abcd")]) for _ in range(120)]
    results = [(rnd.choice(convs), rnd.randint(0, 9), rnd.choice([None, "a", "b", "z"]), str(i)) for i in range(60)]
    got = {r.conv_id: r for r in cf.link_tool_calls(spark.createDataFrame(calls, cf.CALL), spark.createDataFrame(results, cf.RESULT), {"t": {"type": "object"}}).collect()}
    assert got.keys() == set(convs)
    for conv in convs:
        cs, rs = [c for c in calls if c[0] == conv], [r for r in results if r[0] == conv]
        answers = [sorted((r[1], r[3]) for r in rs if r[2] is not None and r[2] == c[2]) for c in cs]
        loose = [r for r in rs if not any(r[2] is not None and r[2] == c[2] for c in cs)]
        g, body = got[conv], json.loads(got[conv].json)
        assert (g.n_calls, g.n_linked, g.n_orphans) == (len(cs), sum(map(bool, answers)), len(loose))
        assert g.n_invalid == sum(c[4] != "{}" for c in cs)
        assert sorted([(r["turn"], r["content"]) for r in s["results"]] for s in body["calls"]) == sorted(answers)
        assert sorted(r["content"] for r in body["orphans"]) == sorted(r[3] for r in loose)


def test_calls_in_texts(spark):
    turns = [(1, 0, "user", '{"name": "sum", "arguments": {"x": 1}, "id": "q"}'), (1, 1, "assistant", "1"), (1, 2, "user", "{no call}"), (1, 3, "tool", None)]
    calls, results = cf.calls_of_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {c.call_id: (c.tool, json.loads(c.arguments)) for c in calls.collect()}
    assert got == {"q": ("sum", {"x": 1}), "call-1-2": ("reply", {"prompt": "{no call}"})} and results.count() == 2


def test_calls_with_ids_link_to_their_results(spark):
    """Conversations of JSON calls and plain ones, linked by brute force."""
    rnd = random.Random(3)
    turns, want = [], {}
    for conv in [*range(40), None]:
        ids, given, linked, orphans = {}, [], 0, 0
        for turn in range(12):
            if turn % 2 == 0:
                ids[turn] = f"id{turn % 6}-{turn}" if rnd.random() < 0.6 else f"call-{conv}-{turn}" if conv is not None else f"call-{turn}"
                own = ids[turn].startswith("id")
                call = {"name": "sum", "arguments": {"x": turn}} | ({"id": ids[turn]} if own else {})
                turns.append((conv, turn, "user", json.dumps(call) if own or rnd.random() < 0.5 else f"text {turn}"))
            elif rnd.random() < 0.8:
                other = rnd.choice([*ids.values(), "unknown"])
                direct = rnd.random() < 0.3
                turns.append((conv, turn, rnd.choice(["assistant", "tool"]), json.dumps({"call_id": other, "v": 1}) if direct else "done"))
                given.append(other if direct else ids[turn - 1])
        want[conv] = (len(ids), sum(i in given for i in ids.values()), sum(g not in ids.values() for g in given), ids)
    rnd.shuffle(turns)
    calls, results = cf.calls_of_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    got = cf.link_tool_calls(calls, results, cf.SCHEMAS).collect()
    assert {r.conv_id: (r.n_calls, r.n_linked, r.n_orphans) for r in got} == {c: w[:3] for c, w in want.items()}
    for c in calls.filter("turn >= 2").collect():
        assert c.after == [want[c.conv_id][3][c.turn - 2]]
    assert all(r.n_cyclic == 0 and [s["turn"] for s in json.loads(r.json)["calls"]] == list(range(0, 12, 2)) for r in got)


def test_order_is_topological():
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randint(1, 12)
        calls = [{"call_id": str(i), "turn": rnd.randint(0, 5), "after": [str(rnd.randrange(n)) for _ in range(rnd.randint(0, 2))]} for i in range(n)]
        done, stuck = cf.order_calls(calls)
        place = {c["call_id"]: k for k, c in enumerate(done)}
        assert len(done) + len(stuck) == n and all(place[a] < place[c["call_id"]] for c in done for a in c["after"])


def test_chat_query(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    got = queries()["op6_chat_format"](spark, data)
    assert got.count() == turns.select("conv_id").distinct().count()
    assert got.agg(F.sum(F.col("n_calls"))).first()[0] == turns.filter("role = 'user'").count()
    assert all(json.loads(r.json) for r in got.collect())


def test_pipeline(spark, tmp_path):
    data = "/root/testdata/sf0.01"  # enough labels to learn from
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, data)
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert docs.count() < before.count() and docs.join(before, "doc_id", "left_anti").count() == 0
        if k == 1:  # brute force: distinct texts less white space
            assert docs.count() == before.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).distinct().count()
    assert docs.filter("NOT round_trip").count() == 0
    assert pipeline.run(spark, data).count() == docs.count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"
LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (1, "same", "en", "a", 4, "x"), (None, "same", "en", "a", 4, "x"), (None, "unique text", "en", "a", 11, "x"), (None, None, "en", None, 0, "x"), (2, "", "en", "b", 0, "x"),
    (5, "x y", "en", "b", 3, "x"), (5, "xy", "en", "b", 2, "x"), (6, "twice", "en", "b", 5, "x"), (6, "twice", "en", "b", 5, "x"), (7, LONG, "en", "c", 1, "x"), (8, LONG.replace("w150 ", "other "), "en", "c", 1, "x"),
    (None, LONG.replace("w20 ", "another "), "en", "c", 1, "x"), (8, "a text of its own under a repeated id", "en", "c", 1, "x"), (9, "word " * 40_000, "en", "c", 1, "x"), (10, "vile words here", "en", "a", 1, "x"), (10, "clean words here", "en", "a", 1, "x"),
]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    """A folder with labels that make "vile" toxic, and documents to learn from."""
    at = str(tmp_path_factory.mktemp("labelled"))
    learn = [(100 + i, f"vile number{i} text here" if i % 2 else f"fine number{i} text here", "en", "z", 1, "x") for i in range(60)]
    spark.createDataFrame([(i, 1, int("vile" in t)) for i, t, *_ in learn], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, learn


def stage(spark, pipeline, k, rows, at):
    got = pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, DOCS).repartition(3), at)
    if k < 4:
        assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    return sorted(map(tuple, got.collect()), key=str)


def test_toxicity_stage_drops_rows_not_ids(spark, labelled):
    pipeline = pytest.importorskip("corpus_pipeline")
    at, learn = labelled
    got = stage(spark, pipeline, 0, ROWS + learn, at)
    assert got == sorted((r for r in ROWS + learn if "vile" not in (r[1] or "")), key=str)
    assert stage(spark, pipeline, 0, [], at) == []


def test_exact_stage_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    best = {}
    for r in ROWS:
        place = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        key = "".join((r[1] or "").split())
        if key not in best or place < best[key][0]:
            best[key] = (place, r)
    assert stage(spark, pipeline, 1, ROWS, "") == sorted((r for _, r in best.values()), key=str)
    assert stage(spark, pipeline, 1, [], "") == []


def test_near_stage_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    grams = [{tuple((r[1] or "").split()[i : i + 5]) for i in range(max(1, len((r[1] or "").split()) - 4))} for r in ROWS]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    want = []
    for g in set(group):
        want.append(min((r for r, x in zip(ROWS, group) if x == g), key=lambda r: (r[0] is None, r[0] or 0)))
    assert [r[:2] for r in stage(spark, pipeline, 2, ROWS, "")] == sorted((r[:2] for r in want), key=str)
    assert stage(spark, pipeline, 2, [], "") == []


def test_mixing_stage_emits_each_row_by_itself(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from kmerloom.llm.mixing import mix

    docs = spark.createDataFrame(ROWS, DOCS)
    got = stage(spark, pipeline, 3, ROWS, "")
    total = mix(docs).agg(F.sum("copies")).first()[0]
    assert len(got) == total and all(got.count(r) <= 2 * ROWS.count(r) for r in set(got))
    assert stage(spark, pipeline, 3, [], "") == []
    assert len(stage(spark, pipeline, 4, ROWS, "")) == len(ROWS) and stage(spark, pipeline, 4, [], "") == []


def test_stages_chained_without_writing(spark):
    """Tables go only when nothing reads them, and columns may have the names that stages use inside."""
    pipeline = pytest.importorskip("corpus_pipeline")
    clash = [F.lit(c).alias(c) for c in ("__row", "__copy", "__copies")]
    docs = spark.createDataFrame(ROWS, DOCS).select("*", *clash)
    once = pipeline.drop_near_copies(spark, pipeline.drop_copies(spark, docs, ""), "")
    more = pipeline.mix_sources(spark, once, "")
    assert once.columns == more.columns == docs.columns
    got = sorted(map(tuple, once.collect()), key=str)
    assert got == [(*r, "__row", "__copy", "__copies") for r in stage(spark, pipeline, 2, [r[:6] for r in map(tuple, pipeline.drop_copies(spark, docs, "").collect())], "")]
    assert {tuple(r) for r in more.collect()} <= set(got)


def test_runs_in_one_session_do_not_share_tables(spark, labelled):
    pipeline = pytest.importorskip("corpus_pipeline")
    at, learn = labelled
    spark.createDataFrame(ROWS + learn, DOCS).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    first = pipeline.run(spark, at)
    pipeline.drop_copies(spark, spark.createDataFrame(ROWS, DOCS), "")
    second = pipeline.run(spark, at)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect())) and first.count()
