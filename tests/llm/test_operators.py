"""Every operator against plain Python on rows with all edge cases, on an
empty table and with clashing extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from corpus_rows import LONG, TEXTS, WHITE, rows
from pyspark.sql import functions as F

import __spark_entry__ as E
from shopfloor.llm import (ann, bpe, components, exact_dedup, feistel, line_dedup, near_dedup, packing, pii, quality,
                           reshard)
from shopfloor.llm.queries import vocabulary_path
from shopfloor.llm.vocab import Vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# -- 5: BPE -----------------------------------------------------------------

def test_bpe_equals_the_library(docs, clashing, empty, tokenizer):
    def expected(t):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    want = sorted(((i, *expected(t)) for i, t, *_ in rows()), key=repr)
    for df in (docs, clashing):
        assert tuples(bpe.encode_decode(df, vocabulary_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(empty, vocabulary_path()).count() == 0


def test_bpe_round_trip_and_random_texts(spark, tokenizer):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab'stmdrevl l  1!é\nΣ日<|>") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, vocabulary_path())
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert all(ids[i] == tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode(encoded, vocabulary_path()).collect()}
    assert all(back[i] == tokenizer.decode(ids[i], skip_special_tokens=False) for i in ids)


def test_a_full_word_table_changes_nothing(tokenizer):
    from shopfloor.llm.tokens import FastIds
    small = FastIds(Vocabulary(vocabulary_path()), most=10)
    texts = [t or "" for t in TEXTS] * 2
    for t in texts:
        assert small.texts([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# -- 6: exact dedup ------------------------------------------------------------

def exact_expected():
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    keep = {k: min(v)[3] for k, v in groups.items()}
    return sorted(((i, keep[k], len(v), i == keep[k], hashlib.sha256(k.encode()).hexdigest())
                   for k, v in groups.items() for *_, i in v), key=repr)


def test_exact_groups(docs, clashing, empty):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for df in (docs, clashing):
        assert tuples(exact_dedup.exact_groups(df), *cols) == exact_expected()
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.deduplicated(clashing).columns == clashing.columns


def test_one_row_of_each_group_stays(spark):
    data = [(None, "alpha"), (None, "beta"), (1, "gamma"), (1, "delta"), (2, "gam ma"), (1, "g amma"), (1, "gamma"), (None, None), (3, " "),
            (None, "alpha")]
    got = exact_dedup.deduplicated(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [(None, "alpha"), (None, "beta"), (1, "delta"), (1, "g amma"), (3, " ")], key=repr)


def test_ids_beyond_the_width_are_an_error():
    assert feistel.narrow(np.array([65_535], "<u4"), "<u2").tolist() == [65_535]
    assert feistel.narrow(np.array([70_000], "<u4"), "<u4").tolist() == [70_000]
    with pytest.raises(ValueError):
        feistel.narrow(np.array([1, 70_000], "<u4"), "<u2")


def test_a_group_larger_than_a_task(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text"))
                                  .otherwise(F.concat(F.lit("text "), "id")).alias("text")).repartition(7)
    got = exact_dedup.exact_groups(df)
    assert got.where("group_size > 1").count() == 1334
    assert got.where("kept").count() == 4000 - 1333
    assert {r.keep_id for r in got.where("group_size > 1").collect()} == {0}


# -- 4: lines -------------------------------------------------------------------

def lines_expected():
    first, windows = {}, []
    data = {(i, t): t.split("\n") for i, t, *_ in rows() if t is not None}
    for (i, t), x in data.items():
        for p in range(len(x) - 2):
            w = tuple(x[p:p + 3])
            if all(re.fullmatch("[ \t\r\f\x0b]*", s) for s in w):
                continue
            windows.append((i, t, p, w))
    order = lambda i: (i is not None, i or 0)
    for i, t, p, w in windows:
        first[w] = min(first.get(w, (order(i), p)), (order(i), p))
    covered = collections.defaultdict(set)
    for i, t, p, w in windows:
        if first[w] != (order(i), p):
            covered[i, t] |= {p, p + 1, p + 2}
    return sorted(((i, 0 if t is None else len(data[i, t]), len(covered[i, t]), None if t is None else "\n".join(
        s for k, s in enumerate(data[i, t]) if k not in covered[i, t])) for i, t, *_ in rows()), key=repr)


def test_line_windows(docs, clashing, empty):
    for df in (docs, clashing):
        assert tuples(line_dedup.with_counts(df), "doc_id", "n_lines", "n_removed", "text") == lines_expected()
    assert line_dedup.with_counts(empty).count() == 0
    assert line_dedup.remove_repeated_lines(clashing).columns == clashing.columns


# -- 3: near dedup ----------------------------------------------------------------

def near_expected(data, width):
    low = {c: c + 32 for c in range(65, 91)}
    sets = collections.defaultdict(list)
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        s = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets[i].append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(docs, clashing, empty, width):
    data = [(i, t) for i, t, *_ in rows() if i is not None]
    want, sets = near_expected(data, width)
    for df in (docs, clashing):
        for r in near_dedup.near_groups(df, width).collect():
            if r.doc_id is None:
                assert r.component_id is None and not r.kept
                continue
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles == len(sets[r.doc_id][0])
    assert near_dedup.near_groups(empty, width).count() == 0
    assert near_dedup.deduplicated(clashing).columns == clashing.columns


def test_near_groups_in_a_large_region(spark, monkeypatch):
    """A region of several blocks: copies of one text with some words changed."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choice(["q", "r", "s"]) + str(k) if rng.random() < rate else w for w in base)
             for k in range(120) for rate in [rng.choice([0, .005, .01, .02, .03, .05])]]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = near_expected(list(enumerate(texts)), 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df, 4).collect()}
    assert got == want


def test_one_row_of_each_component_stays(spark):
    """Replayed rows, copies without an id and ids with several texts: rows are counted, not ids."""
    text = [" ".join(f"t{k}x{i}" for i in range(40)) for k in range(6)]
    data = [(1, text[0])] * 30 + [(2, text[0] + " more"), (3, text[1]), (None, text[1]), (None, text[1] + " end")]
    data += [(None, text[2])] * 20 + [(None, text[2] + " tail")] * 5                    # no id in the whole group
    data += [(6, text[3]), (6, text[4]), (7, text[4]), (6, ""), (8, ""), (8, ""), (None, ""), (None, None), (9, text[5])]
    df = spark.createDataFrame([(i, t, f"r{n}") for n, (i, t) in enumerate(data)], "doc_id long, text string, extra string").repartition(5)
    got = near_dedup.deduplicated(df, 5).collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 1, 3: 1, None: 3, 6: 1, 8: 1, 9: 1}
    assert sorted(r.text or "" for r in got if r.doc_id is None)[:2] == ["", ""]
    assert len({r.extra for r in got}) == len(got) and all((r.doc_id, r.text) == data[int(r.extra[1:])] for r in got)
    rows = near_dedup.near_groups(df, 5).collect()
    assert len(rows) == len(data)
    assert collections.Counter(r.component_id for r in rows if r.doc_id is None) == {3: 2, None: 27}
    assert {r.component_id for r in rows if r.doc_id in (6, 7) and r.n_shingles} == {6}


def test_components_of_a_chain(spark):
    links = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert len(got) == 61 and set(got.values()) == {0}


# -- 2: personal data ----------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15])


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(2)
    parts = ["a", "b@", "@", "c.", ".", " ", "-", "+", "1", "23", "456", "255", "0", "(", ")", "x.y", "4111111111111111", "1.2.3.4"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_spans_and_redaction(docs, clashing, empty):
    for df in (docs, clashing):
        got = sorted(((r.doc_id, [(x.s, x.k, x.e) for x in r.base]) for r in pii.spans(df).collect()), key=repr)
        assert got == sorted(((i, plain_spans(t or "")) for i, t, *_ in rows()), key=repr)
    assert pii.spans(empty).count() == 0
    done = pii.redacted(clashing)
    assert done.columns == clashing.columns
    texts = {r.doc_id: r.text for r in done.collect()}
    assert texts[20] == "mail [EMAIL] or 10.0.0.300 and [IP] card [CARD] call [PHONE] now"
    assert texts[0] is None and texts[15] == LONG


def test_trusted_contexts_add_spans(spark):
    """Numbers that fail the check are found where the context always holds one that passes."""
    def card(k):
        body = f"4{k:014d}"
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
    good = [(k, f"please charge card number {card(k)} today friend{k}") for k in range(30)]
    bad = str(int(card(77)) + 1)
    texts = good + [(100, f"please charge card number {bad} today friend"), (101, f"serial {bad[::-1]} of the machine")]
    got = {r.doc_id: r.added for r in pii.spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    at = texts[30][1].index(bad)
    assert [(x.s, x.k, x.e) for x in got[100]] == [(at, 2, at + 16)]
    assert got[101] == [] and got[3] == []


def card(k, good=True):
    body = f"4{k:014d}"
    c = next(c for c in range(10) if pii.luhn(body + str(c)))
    return body + str(c if good else (c + 1) % 10)


def added_in(spark, texts):
    """Per text, the strings that were added."""
    got = {r.doc_id: r.added for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [[t[x.s:x.e] for x in got[k]] for k, t in enumerate(texts)]


@pytest.mark.parametrize("share", [10, 25, 50])
def test_a_context_may_hold_many_unseen_identifiers(spark, share):
    n = 20
    unseen = [card(100 + k, False) for k in range(n * share // (100 - share))]
    texts = [f"please charge card number {x} today friend" for x in [card(k) for k in range(n)] + unseen]
    assert added_in(spark, texts) == [[]] * n + [[x] for x in unseen]


def test_rounds_go_on_until_nothing_is_added(spark):
    """Each hop's identifiers stand among those of the hop before."""
    hops = [[card(100 * h + k, h == 0) for k in range(5)] for h in range(8)]
    texts = [f"some {'abcdefgh'[h]}tag {x} after {'abcdefgh'[h]}end" for h in range(7) for x in hops[h] + hops[h + 1]]
    want = [[] if x in hops[0] else [x] for h in range(7) for x in hops[h] + hops[h + 1]]
    assert added_in(spark, texts) == want


def test_words_around_a_span_are_whole_and_found_over_white_space(spark):
    long = "q" * 60
    assert pii.contexts(f"x {long}A {long}b" + " " * 200 + "1.2.3.4" + " " * 90 + f"{long}Tail z", 325, 332) == [
        f"l {long}a {long}b", f"b {long}b _ {long}tail"]
    assert pii.contexts("1.2.3.4", 0, 7) == pii.contexts("(: 1.2.3.4 12 %", 3, 10) == []
    assert pii.contexts("a tel:1.2.3.4,b c", 6, 13) == ["l a tel:", "b tel: _ ,b"]


def plain_rounds(texts):
    """The rounds in plain Python: per text, the strings that are added."""
    edges, spots = {}, []
    for t in texts:
        base, here = pii.base_spans(t), []
        for seed, found in ((True, base), (False, pii.candidates(t, base))):
            for s, k, e in found:
                i, ps = pii.instance(t[s:e], k), pii.contexts(t, s, e)
                here.append((seed, not seed and pii.known_wrong(t[s:e]), s, k, e, i, ps))
                for p in ps:
                    old = edges.get((p, k, i), (False, False))
                    edges[p, k, i] = (old[0] or seed, old[1] or here[-1][1])
        spots.append(here)
    seeds = {(k, i) for (_, k, i), (seed, _) in edges.items() if seed}
    for (p, k, i), (seed, wrong) in edges.items():
        other = (k, i) not in seeds and any(x != k and j == i for x, j in seeds)
        edges[p, k, i] = (seed, not seed and (wrong or other))
    believed, trusted = set(seeds), {}
    while True:
        before = len(believed), len(trusted)
        trusted = {}
        for p, k in {(p, k) for p, k, _ in edges}:
            own = {i: x for (q, kk, i), x in edges.items() if (q, kk) == (p, k)}
            good = sum((k, i) in believed for i in own)
            bad = sum(w for _, w in own.values()) + sum(x[0] for (q, kk, _), x in edges.items() if q == p and kk != k)
            many = max(0, sum(not w for _, w in own.values()) - 2 * good)
            if good >= pii.SUPPORT and good / (good + bad + many + pii.DAMPING) >= pii.PATTERN_BOUND:
                trusted[p, k] = good / (good + bad + many + pii.DAMPING)
        miss = collections.defaultdict(lambda: 1.0)
        for (p, k, i), (_, wrong) in edges.items():
            if not wrong and (p, k) in trusted:
                miss[k, i] *= max(1 - trusted[p, k], 1e-12)
        believed |= {x for x, m in miss.items() if 1 - m >= pii.INSTANCE_BOUND}
        if (len(believed), len(trusted)) == before:
            break
    return [[t[s:e] for seed, wrong, s, k, e, i, ps in here if not seed and not wrong and (k, i) in believed
             and any((p, k) in trusted for p in ps)] for t, here in zip(texts, spots)]


def test_rounds_equal_the_plain_version(spark):
    rng = random.Random(22)
    makers = [lambda: card(rng.randrange(90), rng.random() < 0.7), lambda: f"10.0.{rng.randrange(9)}.{rng.choice([7, 7, 300])}",
              lambda: rng.choice(["+1 ", ""]) + f"212 555 01{rng.randrange(40):02d}",
              lambda: f"a{rng.randrange(20)}{rng.choice(['(at)', '@'])}b.example", lambda: "2019-05-12"]
    # contexts of one kind, of several, of a few believed ones among many, and without words
    spots = [("pay with card {} please", [0]), ("see {} or", [1]), ("reach me at {} now", [2]), ("write to {} soon", [3]),
             ("my number is {} ok", [0, 2, 4]), ("{}", [0]), (": {} -", [2]), ("dial {} on", [2, 2, 2, 2, 4])]
    texts = []
    for _ in range(400):
        words, kinds = rng.choice(spots)
        texts.append(words.format(makers[rng.choice(kinds)]()))
    want = plain_rounds(texts)
    assert sum(map(len, want)) > 0 and added_in(spark, texts) == want


def test_ordinary_numbers_stay(spark):
    """A few cards among many other numbers in the same words, or in no words, trust nothing."""
    for words in ("the number is {} and so on", "{}"):
        texts = [words.format(card(k)) for k in range(6)] + [words.format(10 ** 11 + 7 * k) for k in range(400)]
        assert added_in(spark, texts) == [[]] * 406


def test_precision_and_recall_on_planted_contexts(spark):
    """Contexts of cards hold up to half unseen ones; contexts of ordinary numbers hold a few cards."""
    good = [(f"card on file {'abcdef'[c]}list {card(1000 * c + k, k % 10 >= c)} kept safe", k % 10 < c) for c in range(1, 6) for k in range(40)]
    bad = [(f"item code {'uvwxy'[c]}list {card(10 ** 6 + 1000 * c + k, k < 5)} in stock", False) for c in range(5) for k in range(60 * (c + 1))]
    added = added_in(spark, [t for t, _ in good + bad])
    hits = sum(bool(a) for a, (_, y) in zip(added, good + bad) if y)
    assert hits == sum(y for _, y in good + bad) > 0
    assert not any(a for a, (_, y) in zip(added, good + bad) if not y)


def test_evidence_against_a_context(spark):
    """Words that stand around several kinds, and dates, are no sign of one kind."""
    texts = [f"it is the {x} of that" for k in range(8) for x in (card(k), f"10.0.0.{k}", f"a{k}@b.example")]
    texts += [f"it is the {card(500, False)} of that"]
    texts += [f"call us on +1 212 555 01{k:02d} or so" for k in range(8)] + ["call us on 2019-05-12 or so", "call us on 212 555 0177 or so"]
    got = added_in(spark, texts)
    assert got[:-1] == [[]] * (len(texts) - 1) and got[-1] == [texts[-1][11:23]]


# -- 7: quality --------------------------------------------------------------------------

def test_scores(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(i, int("!" not in (t or "")), 0) for i, t, *_ in rows()] + [(1, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = tuples(quality.score(docs, model), "doc_id", "score")
    assert len(got) == len(rows()) and all(0 <= s <= 1 for _, s in got)
    assert got == tuples(quality.score(clashing, model), "doc_id", "score")
    assert quality.score(empty, model).count() == 0
    assert quality.train(empty, labels.where("false")) == ([], 0.0)
    kept = quality.accepted(clashing, model, 0.0)
    assert kept.columns == clashing.columns and kept.count() == len(rows())


def test_one_row_of_a_document_reaches_the_driver(spark, monkeypatch):
    """A labelled document with most of the rows, its texts not all alike."""
    from pyspark.sql.classic.dataframe import DataFrame
    once = [(k, f"text number {k} " * (k % 7 + 1) + "!" * (k % 2 * 40)) for k in range(60)]
    hot = next(k for k in range(1, 60, 2) if zlib.crc32(str(k).encode()) % 5)
    more = [(hot, once[hot][1])] * 200 + [(hot, "zzz " * 30)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    sent, plain = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: sent.append(plain(df)) or sent[-1])
    models = [quality.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (once, once + more[:-1], once + more)]
    assert [len(x) for x in sent] == [sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(60))] * 3
    assert models[0] == models[1]
    rows = [tuple(s) for k, s in zip(sent[2]["_id"], sent[2][quality.STATS]) if k == hot]
    both = quality.with_statistics(spark.createDataFrame([more[0], more[-1]], "doc_id long, text string")).collect()
    assert rows == [min(tuple(r[quality.STATS]) for r in both)]


def test_held_out_accuracy(spark):
    q = E.queries()["op7_rule_ensemble"](spark, "/root/testdata/sf0.01")
    got = q.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.95


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (500, 6)).astype(float)
    y = (z[:, 0] > 0).astype(float)
    w, _ = quality.lasso(z, y, penalty=0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.1


# -- 1: resharding ------------------------------------------------------------------------

def test_flow_moves_the_fewest_bytes():
    supply, room = {0: 100, 1: 10, 2: 40}, {0: 50, 1: 50, 2: 50}
    flow = reshard.min_cost_flow(supply, room)
    assert sum(flow.values()) == 150 and sum(v for (o, n), v in flow.items() if o != n) == 50
    with pytest.raises(ValueError):
        reshard.min_cost_flow({0: 5}, {0: 4})


def test_shards(docs, clashing, empty):
    for df in (docs, clashing):
        got = reshard.reshard(df, F.expr("IF(source IS NULL, NULL, CAST(substring(source, 4) AS INT))"), 5).collect()
        want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows()), key=repr)
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
        for s in range(5):
            slots = sorted(r.slot for r in got if r.shard == s)
            assert slots == list(range(len(slots)))
    assert reshard.reshard(empty, F.lit(0), 5).count() == 0


def test_sizes_are_near_equal(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int")).alias("text"))
    got = reshard.reshard(df, F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 7), 10)
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.005 * sum(sizes)


@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_rewritten_and_untouched_shards_hold_each_row_once(spark, scratch, monkeypatch, chunk):
    monkeypatch.setattr(reshard, "CHUNK", chunk)
    data = [(i, "x" * (i % 13), i % 3) for i in range(60)] + [(None, "no id", k % 4) for k in range(9)]
    data += [(7, "again", k % 3) for k in range(40)] + [(8, None, 2), (8, "", 2), (None, None, None)]
    keep = [(1000 + k, "stays", 5) for k in range(6)] + [(7, "again", 5)] * 3
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(data + keep)], "doc_id long, text string, old int, _row int").repartition(3)
    old = F.col("old")
    total = sum(len((t or "").encode()) + 16 for _, t, _ in data)
    room = {n: total // 4 + 40 for n in range(4)} | {5: sum(len(t) + 16 for _, t, _ in keep)}
    plan = reshard.reshard(df, old, 5, room).cache()
    moves = {(r.old_shard, r.shard) for r in reshard.transfers(plan).collect()}
    assert moves and all(5 not in m for m in moves)
    copied, keep_table = {}, reshard.written
    monkeypatch.setattr(reshard, "written", lambda rows, name: copied.setdefault(name, keep_table(rows, name)))
    reshard.rewrite(df, old, plan, scratch + "/new")
    assert copied["rewrite"].count() == len(data) and copied["rewrite"].where("old_shard = 5").count() == 0
    new = spark.read.parquet(scratch + "/new")
    got = new.collect()
    untouched = [n for n, r in enumerate(data + keep) if r[2] == 5]
    assert sorted([r["_row"] for r in got] + untouched) == list(range(len(data + keep)))
    assert all((r.doc_id, r.text, r.old) == (data + keep)[r["_row"]] for r in got)
    places = lambda x: sorted((s, k) for s, k in x if s != 5)
    assert places((r["_shard"], r["_slot"]) for r in got) == places((r.shard, r.slot) for r in plan.collect())


# -- 8: training order -----------------------------------------------------------------------

def test_permutation():
    for total in (1, 2, 3, 10, 1000, 4097):
        slots = feistel.permuted(np.arange(total), total, key=5)
        assert sorted(slots.tolist()) == list(range(total))
        assert (feistel.permuted(slots, total, key=5, backward=True) == np.arange(total)).all()
    assert (feistel.permuted(np.arange(1000), 1000, 5) != feistel.permuted(np.arange(1000), 1000, 6)).any()


def test_shards_are_read_from_any_slot(spark, docs, empty, tokenizer, scratch):
    seqs, total = feistel.sequences(docs, vocabulary_path(), seq_len=64, per_shard=128)
    seqs = seqs.cache()
    pieces = collections.defaultdict(list)
    for r in sorted(seqs.collect(), key=lambda r: r.seq_no):
        pieces[r.doc_id].append(np.frombuffer(r.ids, "<u2").tolist())
    for i, t, *_ in rows():
        if i != 8:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            assert [x for p in pieces[i] for x in p] == ids
    path = scratch + "/shards"
    blocks = feistel.shard_blocks(seqs, total, 64, 128, block=32, tasks=5)
    # each task has one range of slots, and all about as many blocks
    ends = blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.min("first_slot"), F.max("first_slot"), F.count("*")).orderBy("task").collect()
    assert len(ends) == 5 and all(a[2] < b[1] for a, b in zip(ends, ends[1:]))
    assert max(r[3] for r in ends) - min(r[3] for r in ends) <= 1
    assert sorted(r.first_slot for r in blocks.collect()) == list(range(0, total, 32))
    feistel.write_shards(blocks, path)
    assert spark.read.parquet(path).agg(F.sum("n_records")).first()[0] == total
    want = {r.slot: np.frombuffer(r.ids, "<u2").tolist() for r in seqs.collect()}
    assert sorted(want) == list(range(total))
    got = feistel.read_from(spark, path, 17, 200, 64, 128).collect()
    assert [r.slot for r in got] == list(range(17, 217))
    assert all(np.frombuffer(r.record, "<u2")[:len(want[r.slot])].tolist() == want[r.slot] and len(r.record) == 128 for r in got)
    seqs, total = feistel.sequences(empty, vocabulary_path())
    assert total == 0 and feistel.shard_blocks(seqs, total).count() == 0


# -- 9: packing --------------------------------------------------------------------------------

def check_packing(got, data, tokenizer, window):
    want = collections.Counter((i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 2) for i, t in data)
    seqs, starts = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.start, ids.tolist()))
    assert sorted(seqs) == list(range(len(seqs)))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for (i, *ids), n in want.items():
        assert sorted(x for _, p in starts[i] for x in p) == sorted(ids * n)
        if n == 1:
            assert [x for _, p in sorted(starts[i]) for x in p] == ids
    return sum(window - sum(n for _, n in p) for p in seqs.values()
               if (t := sum(n for _, n in p)) & (t - 1)) / (window * len(seqs))


def test_packing(docs, clashing, empty, tokenizer):
    data = [(i, t) for i, t, *_ in rows()]
    for df in (docs, clashing):
        padding = check_packing(packing.pack(df, vocabulary_path(), window=256, quantum=8).collect(), data, tokenizer, 256)
        assert padding < 0.05
    assert packing.pack(empty, vocabulary_path()).count() == 0


def test_packing_takes_what_least_squares_says():
    rng = np.random.default_rng(3)
    x = rng.random((30, 12))
    truth = np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(x, x @ truth), truth, atol=1e-6)
    histogram = np.bincount(np.minimum(rng.geometric(0.05, 5000), 64), minlength=65)
    histogram[0] = 0
    chosen = packing.plan(histogram, 64)
    taken = np.zeros(65, int)
    for lengths, n in chosen:
        assert sum(lengths) == 64
        for c in lengths:
            taken[c] += n
    assert (taken <= histogram).all()
    assert ((histogram - taken) * np.arange(65)).sum() < 0.05 * (histogram * np.arange(65)).sum()


# -- 10: nearest neighbours -----------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    x = [(int(i), (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1200)]
    x += [(i, [1.0] * 16) for i in range(1200, 1700)]                       # equal vectors
    x += [(1700, None), (1701, []), (1702, [0.0] * 16), (1703, [float("nan")] * 16), (1704, [None] + [1.0] * 15),
          (1705, [1.0] * 3), (1706, [1e300] * 16), (1706, [1e300] * 16), (None, [1.0] * 16), (1750, [float("inf")] * 16)]
    return x


@pytest.mark.parametrize("query_rows", [ann.QUERY_ROWS, 7])
def test_neighbours_and_recall(spark, query_rows):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("x")).withColumn("v", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.search(df, "vec_id % 50 = 0", fit_rows=600, block=100, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v, float) for i, v in data if i is not None and v and len(v) == 16 and None not in v
            and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] / np.abs(good[i]).max() for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = all_ = 0
    for q in [i for i in ids if i % 50 == 0]:
        score = np.round(x @ x[np.searchsorted(ids, q)], 12)
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]].tolist()
        assert [r for r, *_ in got[q]] == [1, 2, 3, 4, 5]
        hit += len(set(best) & {v for _, v, _ in got[q]})
        all_ += 5
        if q in (1200, 1250):
            assert [v for _, v, _ in got[q]] == [v for v in best]
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    assert hit / all_ >= 0.9
    assert ann.search(df.where("false"), "vec_id % 50 = 0").count() == 0
    assert ann.search(df.where("vec_id IN (50, 51)"), "vec_id % 50 = 0").count() == 1


# -- registered queries and the pipeline --------------------------------------------------------------

def test_all_are_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
