"""Each stage of the pipeline against the operator it names, on what the stage before kept."""

import hashlib

import corpus_pipeline
from addrforge.llm import language_id, minhash_dedup, suffix_dedup, toxicity
from addrforge.llm.runtime import cut, mark, release

DIR = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_do_what_their_operators_say(spark):
    since = mark(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], DIR)))
    assert all(k.columns == docs.columns for k in kept[:-1]) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "suffix_dedup", "best_fit_packing"]
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out())
    clean = toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), labels)).filter("predicted = 0")
    assert ids(kept[1]) == ids(clean)
    model = language_id.fit(kept[1].select("doc_id", "text", "lang").filter(~language_id.held_out()))
    assert ids(kept[2]) == ids(language_id.identify(kept[1], model).filter("lang_pred <> 'und' and score >= 0.5"))
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    classes = minhash_dedup.brute_force(texts, minhash_dedup.idf_table(kept[2]))
    assert ids(kept[3]) == sorted(set(classes.values()))
    before, after = {r["doc_id"]: r["text"] for r in kept[3].collect()}, {r["doc_id"]: r for r in kept[4].collect()}
    for (i, _), (n_bytes, n_removed, _, digest) in zip(before.items(), suffix_dedup.brute_force(list(before.values())), strict=True):
        left = after[i]["text"].encode()
        assert after[i]["n_chars"] == len(after[i]["text"]) and (hashlib.sha256(left).hexdigest() == digest or 0 < n_bytes - n_removed - len(left) < 7 * n_removed / 200)
    pieces, filled = {}, {}
    for r in kept[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(pieces) == sorted(after) and all(p == k and s == 4096 * k for listed in pieces.values() for k, (p, s, _) in enumerate(sorted(listed)))
    assert all(sum(n for _, n in f) <= 4096 and sum(n for _, n in f) == max(o + n for o, n in f) for f in filled.values())
    release(spark, since)
    assert mark(spark) == since
