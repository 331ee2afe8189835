"""Ranked search, near-duplicates by MinHash and spelling variants, against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from titlelake.llm import minhash, search, spelling

SCHEMA = "doc_id long, text string, row string, n long, rank int, score long, word string, key long, sid long, root long, own string"


def table(spark, texts, parts=3):
    rows = [(i, t, "x", 1, 1, 1, "w", 1, 1, 1, "o") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Ranked search ----------------------------------------------------------------------


def plain_search(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    held = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked = Counter(term.findall((text or "").translate(LOWER)))
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in asked.items() if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got_search(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def words(rng, n, size):
    """Words of a skewed vocabulary."""
    return " ".join(f"w{int(size * rng.random() ** 3)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = [(i, words(rng, rng.randrange(1, 80), 300)) for i in range(400)]
    docs += [(500, None), (501, ""), (502, " .,;!"), (None, "w1 w2 w290 w3"), (503, "w7 " * 30_000), (504, "É é W1w2 日本語 w5_w6"), (10, "w1 w2")]
    docs += [(600 + i, docs[5][1]) for i in range(12)] + [docs[3]] * 3
    items = [(i, words(rng, 12, 300)) for i in range(30)] + [(30, docs[5][1]), (31, None), (32, "?"), (33, "w1 w1 w1"), (34, "É 日本語 unseen"), (0, "w2 w3"), (33, "w1 w1 w1"), (None, "w250 w9")]
    return docs, items


def asked(spark, items):
    return spark.createDataFrame([(i, t, 1, 1) for i, t in items], "item_id long, text string, doc_id long, score long")


def test_search_equals_scoring_all(spark, corpus):
    docs, items = corpus
    assert got_search(search.search(table(spark, docs), asked(spark, items))) == plain_search(docs, items)


def test_search_in_small_blocks_of_documents_and_queries(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(search, "BLOCK", 1)
    monkeypatch.setattr(search, "QUERIES", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        found = got_search(search.search(table(spark, docs), asked(spark, items), k=3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == plain_search(docs, items, 3)


def test_search_of_empty_tables(spark, empty, corpus):
    docs, items = corpus
    found = search.search(empty, asked(spark, items))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(table(spark, docs), asked(spark, items).limit(0)).count() == 0
    assert search.search(table(spark, [(1, None)]), asked(spark, items)).count() == 0


def test_accumulators_stop_and_results_stay():
    """A rare term's documents are held, those of a common one are not, and scores are whole."""
    size = 2000
    n, counts = np.full(size, 10), np.array([2] * 12 + [1] * (size - 12))
    term = np.concatenate([[0, 1] * 12, [1] * (size - 12)])
    postings = search.Postings(n, counts, term, np.ones(len(term), dtype=np.int64), size, 10 * size)
    found, score = postings.best([(0, 5000), (1, 3)], 10)
    gain = 1_000_000_000 // (1000 + 8 * 100)
    assert found.tolist() == list(range(10)) and set(score.tolist()) == {5003 * gain}
    # With a weight that could still lift others, all are held.
    found, score = postings.best([(0, 1), (1, 5000)], 10)
    assert found.tolist() == list(range(10)) and set(score.tolist()) == {5001 * gain}


def test_terms_over_pieces(monkeypatch):
    text = "Ab1 é-日本 x_y  " * 50
    whole = [t for piece in search.terms(text) for t in piece]
    monkeypatch.setattr(search, "PIECE", 7)
    pieces = list(search.terms(text))
    assert len(pieces) > 20 and [t for piece in pieces for t in piece] == whole
    assert whole[:5] == ["ab1".encode(), "é".encode(), "日本".encode(), b"x", b"y"]


# MinHash ----------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else ({b" ".join(w)} if w else set())


def plain_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: (True, 0))
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], (i is None, i or 0))
    out = []
    for k, (i, s) in enumerate(sets):
        null, first = least[find(k)]
        component = None if null else first
        out.append((i, len(s), component, i == component))
    return sorted(out, key=repr)


def got_components(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + rng.randrange(2)] = [f"e{rng.randrange(1000)}"]
    return " ".join(w)


@pytest.fixture(scope="module")
def similar():
    rng = random.Random(5)
    docs = []
    for family in range(12):
        base = " ".join(f"f{family}x{rng.randrange(400)}" for _ in range(120))
        docs.append(base)
        # Chains too: an edit of an edit is linked by way of it only.
        for _ in range(14):
            docs.append(edited(rng, rng.choice(docs[-8:] if rng.random() < 0.5 else [base]), rng.randrange(0, 9)))
    docs += ["one two three", "ONE  two\tthree", "one two", "a b c d", "a b c d", "a b c d e", "", " \n", None, "é É", "é é"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in enumerate(docs)]
    long = " ".join(f"l{k % 5003}" for k in range(40_000))
    return [*rows, (None, docs[0]), (None, docs[30] + " tail"), (None, "alone one two three four"), rows[7], rows[7], (900, long), (901, long + " end"), (902, "four words stand alone")]


def test_components_equal_all_pairs(spark, similar):
    assert got_components(minhash.near_duplicates(table(spark, similar))) == plain_components(similar)


def test_links_that_no_star_shows_are_found(spark, similar, monkeypatch):
    """With one star a bucket many links of chains are left to the second pass, here in small cells."""
    monkeypatch.setattr(minhash, "PART", 500)
    monkeypatch.setattr(minhash, "FEW_LINKS", 3)
    monkeypatch.setattr(minhash, "SETS", 5)
    monkeypatch.setattr(minhash, "GROUP", 2000)
    assert got_components(minhash.near_duplicates(table(spark, similar))) == plain_components(similar)


def test_a_hot_bucket_is_linear(spark):
    """A group of unlike texts under one key gives one star, not all pairs."""
    key, owner = np.zeros(5000, dtype=np.uint64), np.arange(5000, dtype=np.int64)
    first, lead, member = minhash.stars(key, owner)
    assert first.sum() == 1 and len(member) == 4999 and set(lead.tolist()) == {0}


def test_minhash_of_empty_tables(spark, empty):
    found = minhash.near_duplicates(empty)
    assert found.count() == 0 and found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    only = minhash.near_duplicates(table(spark, [(1, None), (2, ""), (None, None)]))
    assert got_components(only) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def test_tables_are_all_pairs_of_two_collections():
    sub = np.arange(2 * 2 * minhash.SIDE, dtype=np.uint64).reshape(2, -1)
    keys = minhash.table_keys(sub)
    assert keys.shape == (2, minhash.SIDE**2) and len(np.unique(keys)) == keys.size
    other = sub.copy()
    other[1, 0] = sub[0, 0]
    other[1, minhash.SIDE + 2] = sub[0, minhash.SIDE + 2]
    assert (minhash.table_keys(other)[0] == minhash.table_keys(other)[1]).nonzero()[0].tolist() == [2]


def test_pieces_of_a_text_change_no_minhash(monkeypatch):
    own = minhash.shingles(" ".join(f"w{i}" for i in range(3000)), minhash.Words())
    whole = minhash.minhashes(own)
    monkeypatch.setattr(minhash, "PIECE", 100)
    assert (minhash.minhashes(own) == whole).all()


def test_few_links_are_missed():
    """Pairs at the least similarity meet in some table."""
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        x, y = minhash.minhashes(a), minhash.minhashes(b)
        same = (x.reshape(-1, minhash.ROWS) == y.reshape(-1, minhash.ROWS)).all(axis=1)
        missed += not (same[: minhash.SIDE].any() and same[minhash.SIDE :].any()) or (x == y).sum() < minhash.AGREE
    assert missed == 0


# Spelling variants -----------------------------------------------------------------


def plain_variants(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def differ(a, b):
        """One edit, by dynamic programming."""
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1] == 1

    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and differ(v, w)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def got_variants(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["bananana", "aaaaaaaa", "ababababab", "Straßen", "éclairs"]
    pool = []
    for weight, base in enumerate(bases):
        pool += [base] * (5 + 3 * weight)
        for _ in range(8):
            at, kind = rng.randrange(len(base)), rng.randrange(4)
            changed = [base[:at] + base[at + 1 :], base[:at] + "x" + base[at:], base[:at] + "e" + base[at + 1 :], base[:at] + base[at : at + 2][::-1] + base[at + 2 :]][kind]
            pool += [changed] * rng.choice([1, 5, 5, 6, 30])
    rng.shuffle(pool)
    docs = [(i, " ".join(pool[i * 9 : i * 9 + 9]).title() if i % 3 else ", ".join(pool[i * 9 : i * 9 + 9])) for i in range(len(pool) // 9 + 1)]
    # A chain: 5 occurrences, 25, 125.
    docs.append((5000, "chainwordab " * 5 + "chainwordac " * 25 + "chainwordadc " * 125 + "zz zz short shorts " * 6))
    return [*docs, (5001, None), (5002, ""), (5003, "123 +-"), (None, "Straßen straßen " * 4), docs[3], docs[3], (5004, "x" * 200_000 + " " + "longlong " * 7)]


def test_variants_equal_all_pairs(spark, spelt):
    want = plain_variants(spelt)
    assert sum(r[1] is not None for r in want) > 10 and ("chainwordab", "chainwordac", "chainwordadc") in {r[:3] for r in want}
    assert got_variants(spelling.variants(table(spark, spelt))) == want


def test_deeper_paths_and_passed_on_counts_change_nothing(spark, spelt, monkeypatch):
    monkeypatch.setattr(spelling, "SUBTRIE", 3)
    monkeypatch.setattr(spelling, "NODE", 1)
    monkeypatch.setattr(spelling, "HELD", 20)
    assert got_variants(spelling.variants(table(spark, spelt))) == plain_variants(spelt)


def test_counts_beyond_a_byte():
    """Runs of a letter longer than a count can tell are still near each other only if they are."""
    words = ["a" * 254, "a" * 255, "a" * 256, "a" * 257, "a" * 300 + "b", "a" * 300 + "c", "a" * 302]
    vectors = np.frombuffer(b"".join(map(spelling.vector, words)), dtype=np.uint8).reshape(len(words), -1).astype(np.int16)
    order = np.lexsort(vectors.T[::-1])
    search = spelling.Search([words[i] for i in order], [1] * len(words), vectors[order], vectors, words)
    one = np.ones(len(words), dtype=np.int16)
    search.descend(0, len(words), 0, np.arange(len(words)), one, one)
    assert search.near.tolist() == [1, 2, 2, 1, 1, 1, 0]


def test_variants_of_empty_tables(spark, empty):
    found = spelling.variants(empty)
    assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit():
    assert spelling.near("abcdef", "abcdf") and spelling.near("abc", "abd") and spelling.near("abc", "abcc") and spelling.near("abc", "xabc")
    assert not spelling.near("abcd", "abdc") and not spelling.near("abc", "abc") and not spelling.near("abc", "abcde") and not spelling.near("ab", "ba")


def test_the_budget_reaches_all_paths_of_one_edit():
    reached = {counts: (s, d) for counts, s, d in spelling.reached((2, 0, 1))}
    assert reached[2, 0, 1] == (1, 1) and reached[3, 0, 1] == (0, 1) and reached[1, 0, 1] == (1, 0) and reached[1, 1, 1] == (0, 0)
    assert (2, 0, 3) not in reached and all(min(c) >= 0 for c in reached) and len(reached) == 1 + 3 + 2 + 4


# The registered queries --------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_limited_accumulators", "op12_tensored_minhash", "op13_frequency_trie"])
def test_registered_queries_return_the_agreed_columns(spark, name):
    from titlelake.llm.queries import LLM_QUERIES

    kinds = {
        "op11_limited_accumulators": [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")],
        "op12_tensored_minhash": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
        "op13_frequency_trie": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
    }
    found = LLM_QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.dtypes == kinds[name] and found.count() > 0
