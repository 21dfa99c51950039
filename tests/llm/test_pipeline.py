"""The pipeline, stage by stage against brute force, and its stages on awkward rows."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from test_operators import WORD, bag, low, prose, similar

import corpus_pipeline
from tallyrule.llm import bagminhash, common, lines, mixing, pieces, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_read_what_was_written(spark, monkeypatch):
    read = []
    stages = [(name, lambda s, docs, d: (read.append(docs.inputFiles()), docs.where("doc_id % 2 = 0"))[1]) for name in ("one", "two")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() == 100 and "/tables/one-" in read[1][0] and "/tables/two-" in out.inputFiles()[0]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose and junk, lines that many share, near copies, rows without text, id or source."""
    folder, r, texts = tmp_path_factory.mktemp("corpus"), random.Random(7), []
    for i in range(150):
        texts.append(prose(i, r.randint(30, 120)) + ("\nthis line is shared by many documents\n" + prose(i + 1000, 20) if i % 3 == 0 else ""))
    for i in range(20):
        words = texts[i].split(" ")
        words[3] = "other"
        texts.append(" ".join(words))
    texts += [" ".join(r.choice(["$$", "||", "1.5", "%%"]) for _ in range(r.randint(20, 80))) for _ in range(40)]
    texts += ["", None, " \n", texts[5]]
    rows = [(i, t, "en" if i % 2 else None, ["web", "book", "code", None][i % 4], None) for i, t in enumerate(texts)]
    rows.append((None, prose(9999, 50), None, "web", None))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 170), 0) for i in range(0, 210, 2)] + [(None, 1, 0), (1, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def mixed_by_hand(rows):
    """Copies of each row: targets, blocks by highest quotients, one shard for each source, documents in order of their hashes."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    total = Counter()
    for (_, _, _, source, _), n in zip(rows, size, strict=True):
        total[source] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    free, target, budget = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(total.values())
    while free:
        unit = (budget - sum(target.values())) / sum(free.values())
        over = [s for s in free if unit * free[s] > 2 * total[s]] or list(free)
        cut = any(unit * free[s] > 2 * total[s] for s in free)
        for s in over:
            target[s] = 2.0 * total[s] if cut else unit * free[s]
            del free[s]
    quotients = sorted((-target[s] / (2 * k + 1), names.index(s), k) for s in names if target[s] for k in range(int(target[s] / 32) + 50))
    blocks = Counter(names[i] for _, i, _ in quotients[: round(budget / 32)])
    key = lambda i, n: hashlib.md5(f"7|{i if i is not None else f'null|{n}'}".encode()).hexdigest()
    out, at = Counter(), Counter()
    for row, n in sorted(zip(rows, size, strict=True), key=lambda x: key(x[0][0], x[1])):
        s = row[3]
        out[row] += sum(n > 0 and at[s] + n // 2 < blocks[s] * 32 - lap * total[s] for lap in (0, 1))
        at[s] += n
    return +out


def test_pipeline_by_brute_force(spark, corpus, monkeypatch):
    tables = {}
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: tables.setdefault(name, common.stored(df, name)))
    model = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a, **k: model.append(fit(*a, **k)) or model[-1])
    out = corpus_pipeline.run(spark, corpus)
    assert list(tables) == [name for name, _ in corpus_pipeline.STAGES]
    docs = list(rows_of(spark.read.parquet(f"{corpus}/documents.parquet")).elements())

    score = lambda t: quality.scores(quality.matrix([quality.features(t).tobytes()]), model[0])[0]
    kept = list(rows_of(tables["quality_classifier"]).elements())
    assert Counter(kept) == Counter(d for d in docs if score(d[1]) >= quality.THRESHOLD)
    assert sum(d[0] is not None and d[0] < 170 for d in kept) >= 165 and sum(d[0] is not None and 170 <= d[0] < 210 for d in kept) <= 4

    holders = {}
    for i, t, *_ in kept:
        for line in (t or "").split("\n"):
            if len(low(line.strip(" \t\n\x0b\x0c\r"))) >= 20:
                holders.setdefault(low(line.strip(" \t\n\x0b\x0c\r")), set()).add(-1 if i is None else i)
    stays = lambda i, x: len(h := holders.get(low(x.strip(" \t\n\x0b\x0c\r")), ())) < 3 or max(h) == (-1 if i is None else i)
    cut = [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, x)), *rest) for i, t, *rest in kept]
    assert rows_of(tables["line_dedup"]) == Counter(cut) and any(a[1] != b[1] for a, b in zip(kept, cut, strict=True))

    cut.sort(key=lambda d: (d[0] is None, d[0] or 0))
    bags, gone = [bag(d[1]) for d in cut], set()
    comp = list(range(len(cut)))
    for a in range(len(cut)):
        for b in range(a):
            if comp[a] != comp[b] and (bags[a] == bags[b] or similar(bags[a], bags[b]) >= 0.8):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    gone = {a for a in range(len(cut)) if comp[a] != a}
    left = [d for a, d in enumerate(cut) if a not in gone]
    assert gone and rows_of(tables["near_dedup"]) == Counter(left)

    mixed = mixed_by_hand(left)
    assert rows_of(tables["mix_sources"]) == mixed and max(mixed.values()) == 2

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_equal) for r in out.collect()) == Counter((d[0], tuple(sp.encode(d[1])), True) for d in mixed.elements())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, corpus, stage):
    """No rows, rows without anything, and repeated rows pass every stage; all but the last return the columns of documents."""
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "", 0), (2, prose(1, 3000), None, "web", None), (2, prose(1, 3000), None, "web", None), (3, "a\nb", "x", "web", 3)]
    df = spark.createDataFrame(rows, DOCS)
    last = stage is pieces.stage
    for table in (df, df.limit(0)):
        out = stage(spark, table, corpus)
        assert out.columns == (["doc_id", "n_tokens", "ids", "decoded_equal"] if last else df.columns)
        got = out.collect()
        assert bool(got) == (table is df)
        assert last or {r.text for r in got} <= {r[1] for r in rows} | {""}
    assert {f for _, f in corpus_pipeline.STAGES} == {quality.stage, lines.stage, bagminhash.stage, mixing.stage, pieces.stage}
