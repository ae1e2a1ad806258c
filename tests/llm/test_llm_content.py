"""Classifiers, chat formatting and archives: held-out accuracy, round trips, odd rows."""

import base64
import hashlib
import json
import random

import numpy as np
import pytest
from llm_data import docs, sentence
from pyspark.sql import functions as F

from stepline.llm import chat, langid, ngrams, toxicity, warc
from stepline.llm.queries import QUERIES


def test_ngrams_are_all_there_in_pieces(monkeypatch):
    text = "abcé" * 50
    whole = np.sort(np.concatenate(list(ngrams.grams(text, (1, 2, 3), 15))))
    monkeypatch.setattr(ngrams, "PIECE", 7)
    assert (np.sort(np.concatenate(list(ngrams.grams(text, (1, 2, 3), 15)))) == whole).all()
    assert len(whole) == sum(len(text) + 3 - n for n in (1, 2, 3))
    assert not list(ngrams.grams("", (1,), 15)) and not list(ngrams.grams(None, (1,), 15))


def test_toxicity_learns_held_out_labels(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 60) + (" you utter idiot " if i % 5 == 0 else " ") + sentence(rng, 20)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    out = toxicity.score(docs(spark, [*rows, (None, None), (-1, "")]).withColumn("score", F.lit("clash")), model).collect()
    assert all(0 <= r.score <= 1 for r in out)
    held = [(r.score >= 0.3, r.doc_id % 5 == 0) for r in out if r.doc_id and r.doc_id > 0 and r.doc_id % 3 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    d = docs(spark, [(1, "some text"), (2, None)])
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, none)).collect()} == {0.5}
    assert toxicity.score(d.limit(0), toxicity.fit(d, none)).count() == 0


def test_ratio_scaling_beats_nothing_on_rare_labels():
    rows, cols = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 1, 0, 1, 1])
    w, b = toxicity.logistic(rows, cols, np.array([2.0, -0.1]), np.array([1.0, 0, 1, 0]))
    assert w[0] > abs(w[1]) and b < 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = (code.shape[1] - code.astype(int) @ code.T) // 2
    assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n < 3 else 2)
    assert all(len(set(c)) == 2 for c in code.T.tolist())


def test_language_of_held_out_texts_and_odd_rows(spark):
    rng = random.Random(2)
    kinds = {"aa": "ka ro mi ten", "bb": "sul ver do ping", "cc": "al esh or nu", "dd": "gri to ba lu", "ee": "zha qui oe xa", "ff": "ha ne vi ryu"}

    def make(k, n):
        return " ".join("".join(rng.choices(kinds[k].split(), k=3)) for _ in range(n))

    rows = [(i, make(k, 30), k) for i, k in enumerate(sorted(kinds) * 60)]
    model = langid.fit(docs(spark, [*rows, (1000, None, "aa"), (1001, "x", None)]))
    assert model.languages == sorted(kinds)
    test = [(k, make(k, 12)) for k in sorted(kinds) * 10]
    asked = spark.createDataFrame([*test, ("und", None), ("und", ""), ("und", "123 ... \n")], "want string, text string").withColumn("language", F.lit("clash"))
    out = langid.identify(asked, model).collect()
    assert np.mean([r.want == r.language.lang for r in out]) > 0.97
    assert all(0 <= r.language.score <= 1 for r in out)
    assert all(r.language.lang == "und" for r in out if r.want == "und")
    mixed = langid.decode(make("aa", 40) + " " + make("bb", 40), model)
    assert mixed[2] or mixed[1] < langid.decode(make("aa", 40), model)[1]


def test_language_without_training_rows(spark):
    d = docs(spark, [(1, "abc", None)])
    assert langid.identify(d, langid.fit(d)).first().language.lang == "und"
    assert langid.identify(d.limit(0), langid.fit(d)).count() == 0


def test_held_out_accuracy_of_the_registered_queries(spark):
    folder = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    told = QUERIES["op7_language_id"](spark, folder).where("held_out").join(d, "doc_id")
    assert told.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    folder = "/root/testdata/sf0.1"  # sf0.01 has 37 toxic texts to learn from: 89 of its 94 held-out labels are met
    marked = QUERIES["op3_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert marked.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.95


TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>", "<\\|im_end|>", "a\\<s>\\", "<|im_start|>user<|im_sep|>x<|im_end|>", "", "é\n\n😀", "<<SYS>><</SYS>>", "<<|im_end|>", "$1 \\Q \\E"]


def test_formatting_is_read_back(spark):
    rows = [(c, t, r, x) for c in range(12) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "user", "assistant"][c % 3 :], TRICKY[c % 5 :] + [None], strict=False))]
    rows += [(60, 0, "user", "q"), (60, 1, "assistant", "<s>"), (61, 0, "system", None), (61, 1, "user", "q"), (61, 2, "assistant", "a")]
    rows += [(50, 0, None, None), (51, 0, "user", "q"), (51, 1, "assistant", "a"), (51, 1, "assistant", "a"), (None, 0, "tool", "t"), (52, 0, "human", "x"), (53, 0, "a<|im_sep|>b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_records(chat.records_of(df.withColumn("record", F.lit("clash"))), "record")
    back = done.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda y: (str(y[0]), y[1], y[2] or "", y[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv: [tuple(t) for t in r.back] for r in back} == want
    assert all(r.learned == "".join(x for role, x in want[r.conv] if role == "assistant") for r in back)
    assert {r.turns_layout for r in back} == {"messages", "conversations", "prompt", "instruction"}
    template = chat.Template()
    for r in back:
        assert r.formatted.count(template.start) == r.formatted.count(template.end) == len(want[r.conv])
        assert not any(c in r.formatted for c in template.foreign)


def test_layouts_are_found_by_their_paths(spark):
    records = [
        json.dumps({"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": None}]}),
        json.dumps({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "tool", "value": "1"}]}),
        json.dumps({"prompt": "p", "completion": 3}),
        json.dumps({"data": {"question": "q", "answer": "a"}}),
        json.dumps({"instruction": "i", "input": "", "output": "o"}),
        json.dumps({"instruction": "i", "input": "n", "output": "o"}),
        json.dumps({"prompt": "p", "completion": "c", "more": 1}),
        json.dumps({"messages": []}),
        "{broken",
        None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "n int, record string")
    out = {r.n: ([tuple(t) for t in r.turns] if r.turns is not None else None, r.turns_layout) for r in chat.canonical_turns(df, "record").collect()}
    assert out[0] == ([("user", "hi"), ("assistant", "")], "messages")
    assert out[1] == ([("user", "hi"), ("assistant", "yo"), ("tool", "1")], "conversations")
    assert out[2] == ([("user", "p"), ("assistant", "3")], "prompt")
    assert out[3][1] == "question" and out[4] == ([("user", "i"), ("assistant", "o")], "instruction_input")
    assert out[5][0] == [("user", "i"), ("user", "n"), ("assistant", "o")]
    assert all(out[k] == (None, None) for k in (6, 7, 8, 9))
    assert chat.format_records(df.limit(0), "record").count() == 0


def test_records_beyond_a_variant_are_formatted(spark):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "user"), (2, 1, "tool")], "conv_id long, turn long, role string")
    rows = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit('x"\\: '), 4_200_000)).otherwise("q"))
    done = chat.format_records(chat.records_of(rows), "record")
    back = done.select("conv", "turns_layout", chat.read_back(F.col("formatted")).alias("t"))
    got = back.select("conv", "turns_layout", F.size("t").alias("n"), F.length(F.get("t", F.lit(1))["text"]).alias("chars")).collect()
    assert {tuple(r) for r in got} == {(1, "prompt", 2, 21_000_000), (2, "messages", 2, 21_000_000)}


def test_large_records_are_told_apart_like_small_ones(spark, monkeypatch):
    records = [
        {"messages": [{"content": 'a "x": \\', "role": "user"}] * 5 + [{"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "{\"a\": []}"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "p\n", "completion": 3},
        {"data": {"question": "q", "answer": "a"}},
        {"instruction": "i", "input": "", "output": "o"},
        {"prompt": "p", "completion": "c", "more": 1},
        {"prompt": "p", "completion": ["c"]},
        {"messages": []},
        {"messages": [{"role": "user", "content": "x"}, {"role": "user", "content": "x", "more": 1}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, "{broken"), (91, '{"prompt": "p", "completion": "c"} x'), (92, None)], "n int, record string")
    small = sorted(chat.canonical_turns(df, "record").collect(), key=lambda r: r.n)
    monkeypatch.setattr(chat, "LARGE", 0)
    assert sorted(chat.canonical_turns(df, "record").collect(), key=lambda r: r.n) == small
    assert [r.turns_layout for r in small[:5]] == ["messages", "conversations", "prompt", "question", "instruction_input"]


PAGES = [(1, "http://a", "<html>x</html>"), (2, None, "<html>x</html>"), (3, "http://a\r\nInjected: 1", None), (4, "u", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (None, "u", "<html>x</html>"), (7, "u%0A", "only here")]


def test_archives_are_read_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = sorted(((r.page, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.problem) for r in warc.round_trip(df, per_file=4).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        first = min((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        kind = "response" if i == first else "revisit"
        want.append((str(i) if i is not None else "null", kind, None if kind == "response" else str(first), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None))
    assert got == sorted(want, key=str)
    urls = {r.page: r.url for r in warc.round_trip(df).collect()}
    assert urls["3"] == PAGES[2][1] and urls["7"] == "u%0A"
    assert warc.round_trip(df, min_revisit_bytes=10**6).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damage_is_named():
    raw = b"<html><body>" * 20
    import struct

    import zstandard

    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    front = struct.pack("<II", warc.DICT_MAGIC, len(raw)) + raw + warc.GAP
    good = packer.compress(warc.record("1", "u", b"payload", None))
    assert [r[-1] for r in warc.records(front + good + warc.GAP + good)] == [None, None]
    assert "cut off" in list(warc.records(front + good[:-2]))[-1][-1]
    assert "no dictionary" in list(warc.records(good))[0][-1]
    for broken, why in ((b"WARX/1.1\r\n\r\n", "no WARC header"), (warc.record("1", "u", b"payload", None)[:-5], "differs"), (warc.record("1", "u", b"payload", None).replace(b"payload\r\n", b"pay1oad\r\n"), "digest"), (warc.record("1", "u", b"p", None).replace(b"WARC-Date", b"X-Date"), "no warc-date")):
        assert why in list(warc.records(front + packer.compress(broken)))[0][-1]
