"""Operators on sequences and texts: brute force, exact round trips, held-out accuracy."""

import base64
import datetime as dt
import math
import pickle
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import against_sql
from emberlog.llm import language, packing, queries, runs, tokens

SF = "/root/testdata/sf0.001"
VOCAB = tokens.vocab_path("byte_bpe_50k", tokens.VOCAB_DIR)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, name):
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if sql:
        against_sql(df, sql, SF)
    else:
        assert df.count() >= 0


# ------------------------------------------------------------------ runs


def event_table(spark, n=300, seed=1):
    r = random.Random(seed)
    kinds = [["a", "b1"], ["B2", " A "], ["c"], [], None, ["", " "], ["d9", None]]
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, None if r.random() < 0.03 else t0 + dt.timedelta(seconds=r.randint(0, 150)), r.choice(["hot", "HOT ", "x", None, ""]), r.choice(kinds)) for i in range(n)]
    return rows + rows[:40]


def brute_runs(rows):
    seqs = {}
    for i, t, s, tags in {r[0]: r for r in rows if r[1]}.values():
        key = (s or "").strip().lower() or None
        sig = frozenset(x for x in ("".join("#" if c.isdigit() else c for c in (g or "").strip().lower()) for g in tags or []) if x)
        seqs.setdefault(key, []).append((t, i, sig))
    out = []
    for seq in seqs.values():
        seq.sort(key=lambda x: x[:2])
        a = 0
        for b in range(1, len(seq) + 1):
            if b == len(seq) or seq[b][2] != seq[a][2]:
                out.append((seq[a][1], b - a, int((seq[b - 1][0] - seq[a][0]) / dt.timedelta(microseconds=1))))
                a = b
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_runs_against_brute_force(spark, parts):
    rows = event_table(spark)
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp_ntz, source string, tags array<string>").withColumn("n", F.lit("clash"))
    got = runs.collapse_runs(df, "source", "event_id", "event_time", "tags", parts=parts)
    assert sorted((r.first_id, r.n, r.duration_us) for r in got.collect()) == brute_runs(rows)


def test_runs_empty(spark):
    df = spark.createDataFrame([], "event_id long, event_time timestamp_ntz, source string, tags array<string>")
    assert runs.collapse_runs(df, "source", "event_id", "event_time", "tags").count() == 0


def _cost(part, weight):
    n, held = sum(b[4] for b in part), Counter()
    for b in part:
        for t in runs.tag_set(b[0]):
            held[t] += b[4]
    return weight * sum(min(k, n - k) for k in held.values())


def _unpruned(blocks, penalty, weight):
    """(least cost) of all segmentations, by programming without pruning."""
    best = [0.0]
    for t in range(1, len(blocks) + 1):
        best.append(min(best[s] + _cost(blocks[s:t], weight) + penalty for s in range(t)))
    return best[-1]


def _total(found, blocks, penalty, weight):
    """Cost of the runs found; every block lies in exactly one."""
    assert sum(x[4] for x in found) == sum(b[4] for b in blocks)
    return sum(penalty + _cost([b for b in blocks if x[1] <= b[1] <= x[3]], weight) for x in found)


def test_pruned_programming_is_optimal():
    """2,000 random sequences, the state taken down and up again at random places, against unpruned programming."""
    r = random.Random(3)
    sigs = ["", "a\x1fb", "a\x1fc", "b\x1fc", "a\x1fb\x1fc", "z", *[f"a\x1fb\x1fx{i}" for i in range(5)]]
    for _ in range(2000):
        some, blocks = r.sample(sigs, r.randint(2, 8)), []
        for i in range(r.randint(1, 14)):
            blocks.append((r.choice([x for x in some if not blocks or x != blocks[-1][0]]), i, i, i, r.randint(1, 3)))
        penalty, weight = r.choice([0.2, 0.39, 0.7, 1.0, 2.0, 5.0]), r.choice([0.25, 1.0])
        seg, found = runs.Segmenter(penalty, weight), []
        for b in blocks:
            seg.add(b)
            found += seg.certain()
            if r.random() < 0.3:
                state = seg.state()
                seg = runs.Segmenter(penalty, weight)
                seg.resume(pickle.loads(pickle.dumps(state)))
        found += seg.finish()
        assert math.isclose(_total(found, blocks, penalty, weight), _unpruned(blocks, penalty, weight)), (blocks, penalty, weight)


def test_dissimilarity_is_superadditive():
    r = random.Random(4)
    for _ in range(500):
        part = [("\x1f".join(sorted(r.sample("abcd", r.randrange(5)))), i, i, i, r.randint(1, 4)) for i in range(r.randint(2, 9))]
        cut = r.randrange(1, len(part))
        assert _cost(part, 1) >= _cost(part[:cut], 1) + _cost(part[cut:], 1)


def near_events(n=500):
    r, t0 = random.Random(9), dt.datetime(2024, 1, 1)
    kinds = [["a", "b"], ["a", "b", "c"], ["a", "B 7"], ["z"], None]
    return [(i, t0 + dt.timedelta(seconds=i), "hot" if r.random() < 0.8 else r.choice(["x", None]), kinds[min(4, i // 90) if r.random() < 0.7 else r.randrange(5)]) for i in range(n)]


def test_near_runs_whatever_the_partitions(spark):
    rows = near_events()
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp_ntz, source string, tags array<string>")
    for penalty, weight in ((2.0, 1.0), (40.0, 0.5)):
        found = [sorted(map(tuple, runs.collapse_runs(df, "source", "event_id", "event_time", "tags", penalty, weight, parts=p).collect()), key=str) for p in (1, 2, 7, 30)]
        assert found[0] == found[1] == found[2] == found[3]
        sequences = {}
        for i, t, s, tags in rows:
            sig = "\x1f".join(sorted({"".join("#" if c.isdigit() else c for c in x.lower()) for x in tags or []}))
            sequences.setdefault(s, []).append((sig, i, i, i, 1))
        for s, blocks in sequences.items():
            total = sum(penalty + _cost([b for b in blocks if x[2] <= b[1] and x[3] + (b[1] - x[2]) * 10**6 <= x[4]], weight) for x in found[0] if x[0] == s)
            assert math.isclose(total, _unpruned(blocks, penalty, weight))
    assert runs.collapse_runs(df.where("false"), "source", "event_id", "event_time", "tags", 1.0, 1.0).count() == 0


def test_near_runs_of_whole_tables_are_optimal(spark):
    """Every source of the table: the cost of the runs is that of unpruned programming."""
    found = queries.p3_near_runs(spark, SF).collect()
    events = spark.read.parquet(f"{SF}/siem_events.parquet")
    blocks = runs.collapse_runs(events, "source", "event_id", "event_time", "tags").collect()
    by = {}
    for b in sorted(blocks, key=lambda b: (b.entity or "", b.t_first, b.first_id)):
        by.setdefault(b.entity, []).append((b.sig, b.first_id, b.t_first, b.t_last, b.n))
    for source, own in by.items():
        starts = {b[1]: k for k, b in enumerate(own)}
        at = sorted(starts[f.first_event_id] for f in found if f.source == source)
        total = sum(queries.NEAR_PENALTY + _cost(own[a:b], queries.NEAR_WEIGHT) for a, b in zip(at, [*at[1:], len(own)]))
        assert math.isclose(total, _unpruned(own, queries.NEAR_PENALTY, queries.NEAR_WEIGHT))


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def encoder():
    enc = tokens.Encoder(VOCAB)
    enc.merge_vocab = VOCAB
    return enc


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.VOCAB_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def encode(enc, texts):
    out = []
    for a, b, raw, ends in tokens._slices(pa.array(texts, pa.string())):
        counts, flat, _ = enc.encode(raw, ends)
        edges = np.concatenate([[0], np.cumsum(counts)])
        out += [flat[x:y].tolist() for x, y in zip(edges, edges[1:])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="'strevlmd  \n\t1é²中　.,!😀’​\x1c\x00ab", max_size=14), min_size=1, max_size=5))
def test_encoding_like_the_library(texts):
    from tokenizers import Tokenizer

    global _REF, _ENC
    if "_REF" not in globals():
        _REF, _ENC = Tokenizer.from_file(f"{tokens.VOCAB_DIR}/byte_bpe_50k.json"), tokens.Encoder(VOCAB)
        _REF.encode_special_tokens = True
    assert encode(_ENC, texts) == [x.ids for x in _REF.encode_batch(texts, add_special_tokens=False)]


def test_encoding_special_long_and_random_unicode(encoder, reference):
    r = random.Random(2)
    texts = ["", "<|endoftext|> x", "'", "I'll we've 's", "x" * 300_000, " " * 5000 + "a", "\n\n\n", "日本語" * 4000]
    texts += ["".join(chr(c) for c in (r.randint(1, 0x2FFF) for _ in range(60)) if not 0xD800 <= c < 0xE000) for _ in range(200)]
    assert encode(encoder, texts) == [x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]


def test_own_merge_like_the_library():
    with open(VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    merge = tokens.merger(VOCAB)
    for piece in [b" detection", "übergröße".encode(), "中文分词".encode(), b"aaaaaaaaaaaaaaa", b"x", "İstanbul".encode() * 9]:
        assert tokens.merge_pairs(piece, ranks) == list(merge(piece))


def test_encode_corpus_round_trip(spark):
    texts = [None, "", "  a\r\n", "Grüße 😀 the the", "it's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    lengths = tokens.token_lengths(VOCAB)
    with open(VOCAB, "rb") as f:
        piece = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    rows = tokens.encode_corpus(df, offsets=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert b"".join(piece[i] for i in r.ids) == data
        assert [data[o : o + lengths[i]] for o, i in zip(r.offsets, r.ids)] == [piece[i] for i in r.ids]
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert tokens.encode_corpus(df.where("false")).count() == 0


# ------------------------------------------------------------------ containers


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(40, 60))
def test_plan_uses_every_item_once(counts, capacity):
    used = Counter()
    for times, parts in packing.plan_containers(counts, capacity):
        assert times > 0 and sum(n * k for n, k in parts) <= capacity
        for n, k in parts:
            used[n] += k * times
    assert used == Counter(counts)


@pytest.mark.parametrize("seed", range(4))
def test_first_container_has_least_slack(seed):
    r = random.Random(seed)
    items = [r.randint(3, 60) for _ in range(12)]
    counts, capacity = Counter(items), 100
    (_, parts), *_ = packing.plan_containers(counts, capacity)
    top = max(items)
    rest = sorted(items)
    rest.remove(top)
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= capacity - top}
    assert sum(n * k for n, k in parts) == top + max(sums)


def test_packing_places_every_unit(spark):
    sizes = [(1, 0), (2, None), (3, 5), (4, 23), (5, 10), (6, 10), *[(i, 7) for i in range(7, 40)], (7, 7)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("rank", F.lit("clash"))
    rows = packing.pack_documents(df, "doc_id", "n_tokens", [(1, 10), (2, 14)]).collect()
    for container, capacity in ((1, 10), (2, 14)):
        mine = [r for r in rows if r.container_id == container]
        fill = Counter()
        for r in mine:
            if r.bin_no is not None:
                fill[r.bin_no] += r.n_tokens
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        total = Counter()
        for r in mine:
            total[r.doc_id] += r.n_tokens
        want = Counter()
        for k, n in sizes:
            want[k] += n or 0
        assert +total == +want
        assert {r.doc_id for r in mine if r.piece_no > 0} == {k for k, n in sizes if n and n > capacity}
        assert {r.doc_id for r in mine if r.bin_no is None} == {1, 2}
    assert packing.pack_documents(df.where("false"), "doc_id", "n_tokens", [(1, 10)]).count() == 0


# ------------------------------------------------------------------ languages

TEXTS = {
    "en": ["The gateway refused the second login.", "Nobody was on call that night.", "We moved the laptop to another room.", "Which account copied the archive?", "The rule fired again after lunch."],
    "de": ["Das Tor hat die zweite Anmeldung abgelehnt.", "In dieser Nacht war niemand im Dienst.", "Wir haben den Rechner in einen anderen Raum gebracht.", "Welches Konto hat das Archiv kopiert?", "Die Regel schlug nach dem Essen wieder an."],
    "ru": ["Шлюз отклонил второй вход.", "Той ночью никто не дежурил.", "Мы перенесли ноутбук в другую комнату.", "Какая запись скопировала архив?", "Правило снова сработало после обеда."],
    "ja": ["ゲートは二回目のログインを拒否しました。", "その夜は当番がいませんでした。", "端末を別の部屋に移しました。", "どの口座が書庫を複写しましたか？", "昼食の後に規則がまた動きました。"],
}


@pytest.fixture(scope="module")
def model():
    pairs = [(language.sentences(t)[0], k) for k, v in TEXTS.items() for t in v]
    return language.LanguageModel.fit([t for t, _ in pairs], [k for _, k in pairs])


def test_table_scores_are_the_kernel_machine(model):
    """The precomputed rows give exactly the kernel expansion over the landmarks."""
    a, b = "the gateway refused", "das tor hat"
    both = model.scores([a, b])
    assert np.allclose(both[0], model.scores([a])[0], atol=1e-5)
    assert model.scores_cached([b, a, b], {}).shape == (3, 4)
    assert model.scores([]).shape == (0, 4)


def test_held_out_sentences(model):
    held = {"en": "the second account was moved after that night", "de": "der zweite rechner war nach dieser nacht im raum", "ru": "после обеда никто не скопировал архив", "ja": "別の端末はログインを拒否しました"}
    said = model.scores(list(held.values())).argmax(1)
    assert [model.languages[i] for i in said] == list(held)


def test_held_out_accuracy_on_documents():
    """Fitted on every other document; the label of a held-out document in one language agrees with the model."""
    import pyarrow.parquet as pq

    names = {r["lang"]: r["lang"] for r in pq.read_table("/root/testdata/sf0.01/lang_codes.parquet").to_pylist()}
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    said = {}
    for d in docs[::2]:
        if d["lang"] in names:
            for s in language.sentences(d["text"])[:12]:
                said.setdefault(s, Counter())[d["lang"]] += 1
    m = language.LanguageModel.fit(*language.chosen_sentences(said))
    right = total = 0
    for d in docs[1::2]:
        own = language.sentences(d["text"])
        if own and d["lang"] in m.languages:
            path, _ = language.decode(m.scores(own))
            if len(set(path)) == 1:
                total += 1
                right += m.languages[path[0]] == d["lang"]
    assert total > 200 and right / total > 0.88  # labels themselves are wrong in about a tenth of the documents


def test_labels_and_segments(spark, model):
    codes = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("ru", "rus", "Russian"), ("ja", "jpn", "Japanese")], "lang string, code3 string, english_name string")
    en, de, ru, ja = (" ".join(TEXTS[k][:2]) for k in ("en", "de", "ru", "ja"))
    docs = [
        (1, en, "EN_gb"), (2, en, " english "), (3, en, "de"), (4, en, None), (5, de, "xx"), (6, f"{en}\n\n# Titel\n\n{de}", "en"), (7, f"{en}\n\n```\nfoo(bar)\n```\n<13>2024-01-01T00:00:00Z h app[1]: x=1\n\n{en}", "eng"),
        (8, None, None), (9, "", "en"), (10, "sha256:" + "ab" * 32, None), (11, f"{ru} {ja}{de}", "ru"), (12, f"{de} {en} {de}", "de"), (13, (en + " ") * 3000, "German"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("segments", F.lit("clash"))
    out = language.label_documents(df, codes, model=model)
    status = {r.doc_id: r.status for r in out.collect()}
    assert status == {1: "right", 2: "right", 3: "wrong", 4: "missing", 5: "missing", 6: "mixed", 7: "right", 8: "no_sentence", 9: "no_sentence", 10: "no_sentence", 11: "mixed", 12: "mixed", 13: "wrong"}
    segs = {}
    for r in sorted(language.segments_of(out).collect(), key=lambda r: (r.doc_id, r.segment_no)):
        segs.setdefault(r.doc_id, []).append(r.segment_lang)
        assert 0 < r.confidence <= 1
    assert segs == {3: ["en"], 4: ["en"], 5: ["de"], 6: ["en", "de"], 11: ["ru", "ja", "de"], 12: ["de", "en", "de"], 13: ["en"]}
    assert language.label_documents(df.where("false"), codes, model=model).count() == 0


def test_short_sentences_are_kept():
    assert language.sentences("No. Sí. Ok. Ja.") == ["no sí ok ja"]
    assert language.sentences("We met Dr. Who there. Ok.") == ["we met dr", "who there ok"]
    assert language.sentences("Ok.\nWe went home then.\nNo.") == ["ok we went home then no"]
    assert language.sentences("12. #1!\n") == []


CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French")]


def test_sample_is_drawn_from_the_whole_table(spark):
    """German comes last and is rare; French has no document."""
    en = ["The server restarted after the update.", "Nobody noticed that the backup had failed.", "Please check the report tomorrow."]
    de = ["Der Server wurde nach dem Update neu gestartet.", "Niemand bemerkte, dass die Sicherung fehlschlug.", "Bitte morgen den Bericht prüfen."]
    rows = [(i, en[i % 3], "EN-us") for i in range(600)] + [(600 + i, de[i % 3], "de") for i in range(30)] + [(900, de[0], None), (901, en[1], "german"), (902, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    codes = spark.createDataFrame(CODES, "lang string, code3 string, english_name string")
    with pytest.warns(UserWarning, match="fr"):
        out = {r.doc_id: r for r in language.label_documents(df, codes).collect()}
    assert (out[900].lang, out[900].status, out[901].lang, out[901].status, out[902].status) == ("de", "missing", "en", "wrong", "no_sentence")
    with pytest.warns(UserWarning):
        unfit = language.label_documents(df.withColumn("lang", F.lit("?")), codes).collect()
    assert len(unfit) == len(rows) and {(r.status, r.lang) for r in unfit} == {("no_sentence", None)}
    with pytest.warns(UserWarning):
        assert language.label_documents(df.where("false"), codes).count() == 0


def test_nothing_else_imports_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "emberlog")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "emberlog.llm" not in text.read()
