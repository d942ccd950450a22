import random
import zlib

import numpy as np
import pytest

from addrforge.llm import bpe, embedding_dedup, html_text, language_id, license_scan, minhash_dedup, nearest, packing, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, runs string, node string"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    shared = words(99, 80)
    base = words(1, 200)
    near = base.split()
    near[100] = "changed"
    return [None, "", "a", "Ünï cödé 😀 " * 3, base, base, " ".join(near), words(2, 300) + " " + shared, shared + " " + words(3, 50), "ab" * 400, words(4, 20000), "licensed under CC BY 4.0. All rights reserved", "x \x1c y  z\n\n w"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, 0, "k", "r", "n") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None, None, None), (4, texts[4], "en", "s", 0, "k", "r", "n")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup_equals_brute_force(docs, none):
    rows = docs.collect()
    want = sorted(zip([r["doc_id"] if r["doc_id"] is not None else -1 for r in rows], suffix_dedup.brute_force([r["text"] for r in rows]), strict=True))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r)[1:]) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, carry=("lang", "runs")).drop("lang", "runs")).collect())
    assert got == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_minhash_equals_brute_force(docs, none, texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    want = minhash_dedup.brute_force({i: t for i, t in enumerate(texts)}, minhash_dedup.idf_table(docs))
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] is None
    assert want[5] == want[6] == 4
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.keep_one(docs).count() == len(texts) - 2 + 1


def changed(text, at):
    held = text.split()
    for k in at:
        held[k] = f"changed{k}"
    return " ".join(held)


def test_minhash_finds_hubs_and_chains_whatever_their_ids(spark):
    rng = random.Random(7)
    hub = words(11, 200)
    star = [changed(hub, rng.sample(range(200), 3)) for _ in range(60)]
    star.insert(30, hub)
    chain = [words(12, 200)]
    while len(chain) < 40:
        chain.append(changed(chain[-1], (5 * len(chain) - 5 + np.array([0, 65, 130])) % 200))
    rng.shuffle(chain)
    texts = star + chain
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(table).collect()}
    want = minhash_dedup.brute_force(dict(enumerate(texts)), minhash_dedup.idf_table(table))
    assert got == want
    assert len(set(want[i] for i in range(61))) < 8


def test_bpe_equals_the_library(docs, none, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    coded = bpe.encode(docs, path)
    for r in coded.filter("doc_id is not null").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded, path).collect()}[3] == texts[3]
    trie = bpe.encoder(path)
    odd = ["a  b", "a   ", "  a", "<|endoftext|>x<|endoftext|>", "it's we'll", "　 a  b", "a\x1d b", "1²³ 4"]
    assert [np.frombuffer(x, "<u4").tolist() for x in trie.encode_batch(odd)] == [e.ids for e in tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert bpe.encode(none, path).count() == 0


def test_packing(docs, none, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert by_doc[i] == {(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none, packing.tokenizer_path()).count() == 0


def test_packing_ids_of_odd_strings_are_the_librarys():
    import random

    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(packing.tokenizer_path()), packing.SpacedEncoder(packing.tokenizer_path())
    rng = random.Random(5)
    odd = ["Σας ΟΔΟΣ é É İ ǅ ½²³ª don't I'LL we'Re '' 's ''t <|endoftext|> <|startoftext|>a <|END \xad x\x85y\x1cz e\u0301 ẞ ß a<|endoftext|>b 1a2b × ÷ a_b \x00 \x7f k \u200bq ﬁ", ""]
    odd += ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(1, 256), rng.randrange(32, 127), 39, 32])) for _ in range(300)) for _ in range(200)]
    for text, ids in zip(odd, own.encode_batch(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once_and_fills_well():
    counts = {n: 1 + (n * 7) % 5 for n in range(1, 400, 3)}
    planned = packing.plan(counts, 1000)
    used = {}
    for members, times in planned:
        assert sum(n * u for n, u in members) <= 1000
        for n, u in members:
            used[n] = used.get(n, 0) + u * times
    assert used == counts
    assert sum(t for _, t in planned) <= -(-sum(n * c for n, c in counts.items()) // 1000) + 1
    assert packing.plan({6: 1, 5: 1, 4: 1, 3: 1}, 10) and sum(t for _, t in packing.plan({7: 1, 2: 1, 5: 2, 3: 1}, 12)) == 2


def test_language_id(spark, none):
    rows = [(i, ("the house and the garden " if i % 2 else "der garten und das haus ") * (1 + i % 3), "en" if i % 2 else "de", None, 0, "", "", "") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([(0, None), (1, ""), (2, "123 !!"), (3, "the garden and the house"), (4, "das haus und der garten"), (None, "the house")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(asked, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] == got[None][0] == "en" and got[4][0] == "de" and got[3][1] > 0.9
    empty = language_id.fit(none)
    assert language_id.identify(asked, empty).filter("lang_pred <> 'und'").count() == 0


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang_pred = lang").count() >= 0.98 * got.count()


def test_toxicity(spark, none):
    lexicon = toxicity.Lexicon({"idiot": 3.0, "worthless": 3.0, "scum": 3.0, "boco*": 2.0})
    assert lexicon.find("idiot") == ("idiot", 0) and lexicon.find("idiiot") == ("idiot", 1) and lexicon.find("wrthles") is not None
    assert lexicon.find("scun") is None and lexicon.find("bocoxyz") == ("boco*", 0) and lexicon.find("house") is None
    plain, quoted = toxicity.evidence("you idiot go away", lexicon)[0], toxicity.evidence('he said "you idiot" and left', lexicon)[0]
    assert plain > quoted > 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert toxicity.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).filter("predicted = 0").count() == 2


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_plain_distances_over_the_lexicon():
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abcd") for _ in range(rng.randint(a, b)))
    for _ in range(20):
        terms = {word(3, 11) + rng.choice(["", "*"]): float(rng.randint(1, 9)) for _ in range(12)}
        lexicon = toxicity.Lexicon(terms)
        near = [t.rstrip("*")[:i] + word(0, 2) + t.rstrip("*")[i + rng.randint(0, 2) :] + word(0, 2) for t in terms for i in range(4)]
        for w in {word(1, 14) for _ in range(60)} | set(near):
            best = None
            for term, weight in terms.items():
                body = term.rstrip("*")
                edits = min((plain_distance(body, w[:j]) for j in range(len(w) + 1))) if term.endswith("*") else plain_distance(body, w)
                if edits <= toxicity.allowed(len(body)):
                    best = min(best or (edits, -weight, term), (edits, -weight, term))
            assert lexicon.find(w) == (best and (best[2], best[0])), (terms, w)


def test_misspelled_forms_of_a_stem_are_caught_and_ordinary_words_are_not():
    rows = [("idio*", 20, 0, 169.0), ("idiot", 15, 0, 140.0), ("worthles*", 12, 0, 120.0)]
    terms = toxicity._choose(rows, 50, 50)
    assert set(terms) == {"idio*", "idiot", "worthles*"} and terms["idiot"] == terms["idio*"]
    lexicon = toxicity.Lexicon(terms, frozenset({"idoit"}))
    assert lexicon.find("idxot") == ("idiot", 1) and lexicon.find("idiots")[1] == 0 and lexicon.find("wortless") == ("worthles*", 1)
    assert lexicon.find("idoit") is None and toxicity.Lexicon({"idio*": 1.0}, frozenset({"idiom"})).find("idiom") == ("idio*", 0)


def test_stems_are_counted_where_they_match():
    terms = toxicity._terms_of("los loser")
    assert {"los", "los*", "loser", "lose*", "loser*"} <= terms
    lexicon = {t: toxicity.Lexicon({t: 1.0}) for t in terms}
    assert all(any(lexicon[t].find(w) == (t, 0) for w in ("los", "loser")) for t in terms)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = {(x["predicted"], x["toxic"]): x["count"] for x in got.groupBy("predicted", "toxic").count().collect()}
    assert r[1, 1] / (r[1, 1] + r.get((1, 0), 0)) > 0.85 and r[1, 1] / (r[1, 1] + r.get((0, 1), 0)) > 0.8


def test_license_scan(docs, none):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert got[0]["n_words"] == 0 and got[0]["first_word"] is None and got[0]["labels"] == ""
    assert (got[11]["n_words"], got[11]["n_base"], got[11]["first_word"], got[11]["last_word"], got[11]["base_labels"]) == (9, 2, 2, 6, "cc-by,reserved")
    assert "cc-by-4.0" in got[11]["labels"].split(",")
    assert license_scan.scan(none).count() == 0


def test_html():
    page = '<html><body><nav><a href="/">Home</a></nav><div class="ad">Buy the best of the things now and for ever and ever, it is the one to have.</div><article><h1>A title</h1><p>The first of the paragraphs is long enough for it to be told by the words that are in it.<p>Short &amp; sweet.<p></article><script>var a="<p>";</script><!-- <p>x --><footer>&copy; all of it</footer>'
    assert html_text.main_text(page) == "A title\nThe first of the paragraphs is long enough for it to be told by the words that are in it.\nShort & sweet."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "" and html_text.main_text("<!-- x") == ""


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i] + 0.05 * rng.standard_normal(16)], i % 2) for i in range(20)] + [(200 + i, rows[0][1], 0) for i in range(30)]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] + [1.0] * 15, 0), (305, rows[1][1], None), (None, rows[1][1], 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, cell string")


def test_embedding_links_equal_brute_force(spark):
    rows, table = vectors(spark)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])) & ~np.eye(len(rows), dtype=bool)
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(table).collect()}
    assert [got[r[0]]["n_links"] for r in rows] == linked.sum(1).tolist()
    assert got[229]["component_id"] == 0 and got[300]["component_id"] == 300 and got[300]["n_links"] == 0 and got[None]["component_id"] is None
    assert embedding_dedup.link_vectors(table.limit(0)).count() == 0


def test_embedding_pairs_at_the_threshold_share_a_filter(spark):
    rng = np.random.default_rng(12)
    x, y = rng.standard_normal((2, 10000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v, "a") for i, v in enumerate(np.concatenate((x, y)).tolist())], "vec_id long, embedding array<double>, label string")
    assert {r["n_links"]: r["count"] for r in embedding_dedup.link_vectors(table).groupBy("n_links").count().collect()} == {1: 20000}


def test_embedding_lengths_are_all_linked(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(8, 78):
        v = rng.standard_normal(d)
        rows += [(2 * d, v.tolist(), "a"), (2 * d + 1, (v + 1e-3 * rng.standard_normal(d)).tolist(), "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert [tuple(r) for r in embedding_dedup.link_vectors(table).groupBy("n_links").count().collect()] == [(1, 140)]


def test_nearest_recall(spark):
    rows, table = vectors(spark)
    got = {}
    for r in nearest.nearest_neighbours(table, table.filter("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids, x = np.array([r[0] for r in rows] + [305]), np.array([r[1] for r in rows] + [rows[1][1]], np.float32).astype(float)
    hits = 0
    for q, found in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:5]]
        hits += len({v for _, v in found} & set(want.tolist()))
    assert hits >= 0.9 * 5 * len(got)
    assert nearest.nearest_neighbours(table.limit(0), table.limit(0)).count() == 0


def test_quotation_is_judged_in_the_hits_own_sentence():
    lexicon = toxicity.Lexicon({"idiot": 2.0})
    quoted = lambda text: toxicity.evidence(text, lexicon)[1][0][2]
    assert quoted('"you idiot"') and quoted('Then "You idiot." came from afar') and quoted("he said idiot")
    assert not quoted("He said nothing. You idiot") and not quoted('"Yes." You idiot, go') and not quoted("you idiot")


def test_mixture_takes_as_many_languages_as_the_words_need():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6):
        likelihood = np.full((n * 40, 7), -12.0, np.float32) + rng.random((n * 40, 7)).astype(np.float32)
        likelihood[np.arange(n * 40), np.repeat(np.arange(n), 40)] = -4.0
        got = language_id._mixtures(np.concatenate((likelihood, likelihood[:40])), np.array([0, n * 40, n * 40, n * 40 + 40]))
        assert (got[0] > 1e-3).sum() == n and np.allclose(got[0][:n], 1 / n, atol=0.02) and (got[2] > 1e-3).sum() == 1
