"""What an operator must not leave out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers

from loomline.llm import chat, decontaminate, licenses, packing, quality, queries, tokens, toxicity, urls


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(n))


def test_partial_passages(spark):
    """Thirteen words of an item are found wherever they stand in it, and with a few edits."""
    rng = random.Random(11)
    short, long = letters(rng, 30), letters(rng, 60)
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    cut = lambda item, at: " ".join(item.split()[at : at + 13])
    texts = {(i, at): f"{letters(rng, 9)} {cut(item, at)} {letters(rng, 9)}" for i, item in ((1, short), (2, long)) for at in range(0, len(item.split()) - 12)}
    texts[1, 99] = f"{letters(rng, 9)} {' '.join(short.split()[:15]).replace('a', 'z', 3)} {letters(rng, 9)}"
    rows = [(n, t) for n, t in enumerate(texts.values())] + [(1000 + i, letters(rng, 40)) for i in range(5)]
    found = {r.doc_id: r["__items"] for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(found) == set(range(len(texts)))
    assert all([h.item_id for h in found[n]] == [k[0]] for n, k in enumerate(texts))


def test_quality_of_small_groups(spark):
    """Groups of any size get a distance: by their source, else by their language, else by all documents."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120))
    junk = lambda: " ".join(w + "%%$$" for w in text().split())
    rows, at = [], 0
    for lang, source, good, bad in (("en", "s", 90, 3), ("fr", "s", 70, 3), ("fr", "t", 9, 1), ("de", "s", 12, 1), (None, None, 3, 1)):
        for t in [*[text() for _ in range(good)], *[junk() for _ in range(bad)]]:
            rows.append((at, t, lang, source))
            at += 1
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and all(r["__distance"] is not None for r in got)
    assert all(r["__kept"] == ("%" not in r["text"]) for r in got)


def test_short_notices(spark):
    """Notices of a line get a label, also with a word changed, and the families' members are told apart."""
    by, nc = licenses.TEMPLATES["cc-by"], licenses.TEMPLATES["cc-by-nc"]
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "This work is licensed under the GNU Genral Public License.": "gpl",
        by: "cc-by",
        nc: "cc-by-nc",
        by.replace("4 0", "3 0"): "cc-by",
        nc.replace("4 0", "3 0"): "cc-by-nc",
        by.replace("creative", "creativ"): "cc-by",
        "the GNU general public license is long": "",
        "a work licensed under the terms of the seller": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[n] for n, t in rows} == texts


def slow_labels(text):
    """Labels of templates by the best window: for every place, the grams of the template within one and a half of its length."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    own, found = grams(words), {}
    more = [(label, t) for label, ts in licenses.NOTICES.items() for t in ts]
    for label, template in [*licenses.TEMPLATES.items(), *more]:
        want = grams(template.split())
        need = min(-(-7 * len(want) // 10), max(len(want) - 3, licenses.LEAST))
        best = max((len(set(own[i : i + len(want) + len(want) // 2]) & set(want)) for i in range(len(own))), default=0)
        if best >= need:
            found[label] = max(found.get(label, 0), best / len(want))
    return found


def test_licenses_among_scraps(spark):
    """Scraps of a template before or after a whole one don't hide it, nor do insertions; scattered scraps alone are none."""
    mit, bsd = licenses.TEMPLATES["mit"], licenses.TEMPLATES["bsd"]
    half = mit.split()
    texts = {
        "permission is hereby " * 20 + mit: "mit",
        mit + " associated documentation files" * 20: "mit",
        "permission is hereby " * 20 + mit + " associated documentation files" * 20: "mit",
        " ".join(half[:10] + ["four", "words", "more", "here"] + half[10:]): "mit",
        " ".join(half[:10] + half[13:]): "mit",
        (bsd + " and ") * 3 + mit: "bsd,mit",
        "permission is hereby " * 60: "",
        " ".join(half[12:] + half[:12]): "",
        " ".join(" ".join(half[i : i + 3]) + " other words between them all" for i in range(0, 20, 3)): "",
        ("filler " * 50 + mit + " ") * 40: "mit",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[n].labels for n, t in rows} == texts
    for n, t in rows:
        if n != 7:  # a template with its halves exchanged: the window has all its grams, but not in order
            assert sorted(slow_labels(t)) == [x for x in texts[t].split(",") if x]
    assert len(got[9].spans) == 40


def test_packing_shares_sequences_across_partitions(spark):
    """However the table is cut, there are about as few sequences as the ids need, and each is gapless."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = {}
    for n in (1, 16, 64):
        got = packing.pack(docs.repartition(n), public_tokenizers.path("word_bpe_49k.json")).select("sequence_id", "offset", "length").collect()
        bins = {}
        for r in sorted(got, key=lambda r: r.offset):
            assert bins.get(r.sequence_id, 0) == r.offset
            bins[r.sequence_id] = r.offset + r.length
        assert max(bins.values()) <= 2048
        counts[n] = len(bins)
        bound = -(-sum(bins.values()) // 2048)
    assert all(c <= bound * 1.01 for c in counts.values()), (counts, bound)


def test_packing_query(spark):
    """The registered query: every document once, its pieces in order, no id lost."""
    got = queries.op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()]
    assert sorted({r.doc_id for r in got}) == sorted(ids)
    for i in ids:
        at = 0
        for n, r in enumerate(sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            at += r.length


def test_blocks_of_the_benchmark_give_one_row(spark, monkeypatch):
    """However many blocks the benchmark is searched in, a row comes once with all its items, and repeated rows stay repeated."""
    rng = random.Random(21)
    items = [(i, letters(rng, 20)) for i in range(12)]
    texts = [f"{items[0][1]} {letters(rng, 5)} {items[5][1]} and {items[9][1]}", items[3][1], items[3][1], letters(rng, 50), None]
    docs = spark.createDataFrame([(n, t, None, "x") for n, t in enumerate(texts)] + [(1, texts[1], None, "x")], "doc_id long, text string, note string, __parts string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    said = lambda: sorted((r.doc_id, sorted(tuple(x) for x in r["__items"])) for r in decontaminate.contamination(docs, bench).collect())
    want = said()
    assert [k for k, _ in want] == [0, 1, 1, 2] and [x[0] for x in want[0][1]] == [0, 5, 9]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert said() == want
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


def test_banded_alignment():
    """With diagonals bounded, the least edits of a path that stays on them: that of the full table with all others closed."""

    def slow(p, t, low, high):
        far = 99
        d = [[far] * (len(t) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) + 1):
            for j in range(len(t) + 1):
                if low <= j - i <= high:
                    d[i][j] = 0 if i == 0 else min(d[i - 1][j - 1] + (p[i - 1] != t[j - 1]) if j else far, d[i - 1][j] + 1, d[i][j - 1] + 1 if j else far)
        return min(d[-1])

    rng = np.random.default_rng(3)
    for _ in range(300):
        p, t = (rng.integers(0, 3, rng.integers(1, 12)) for _ in range(2))
        low = int(rng.integers(-4, 3))
        high = low + int(rng.integers(0, 6))
        best, got = slow(p.tolist(), t.tolist(), low, high), decontaminate.align(p, t, 20, low, high)
        assert (got is None and best > 20) or got[0] == best


def slow_search(index_items, text, budget):
    """Items of which some window has an occurrence with few enough edits, by the full table at every place."""
    chars = decontaminate.normalized(text)[0].astype(int)
    found = set()
    for item, item_text in index_items:
        own = decontaminate.normalized(item_text)[0].astype(int)
        m = len(own)
        for n, by in ((budget.window, budget.window // 2), (budget.part, budget.stride)):
            for lo in {*range(0, m - n, by), max(0, m - n)}:
                part = own[lo : lo + n]
                if len(part) >= decontaminate.Q and decontaminate.align(part, chars, decontaminate.edits_allowed(len(part), budget.edit_percent)) is not None:
                    found.add(item)
    return found


def test_search_equals_alignment_everywhere(monkeypatch):
    """The lemma loses nothing: random edits of pieces of items, and a frequent gram in a long text, in portions of any size."""
    rng = random.Random(31)
    items = [(i, letters(rng, 14)) for i in range(4)] + [(9, "ab" * 60)]
    budget = decontaminate.Budget()
    index = decontaminate.Index(items, budget)
    for n in range(25):
        piece = list(rng.choice(items)[1][: rng.randint(50, 90)])
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(piece))
            piece[at : at + 1] = rng.choice([[], ["q"], [piece[at], "r"]])
        text = f"{letters(rng, 8)} {''.join(piece)} {letters(rng, 8)}"
        want = slow_search(items, text, budget)
        for portion in (2_000_000, 50):
            monkeypatch.setattr(decontaminate, "PORTION", portion)
            assert {x[0] for x in index.search(text)} == want, text
    monkeypatch.setattr(decontaminate, "PORTION", 10_000)
    assert {x[0] for x in index.search("ab" * 20_000 + " " + items[2][1])} == {2, 9}


def test_many_rules(spark, monkeypatch):
    """Rules of many label counts and path lengths, by broadcast and by shuffle, against a scan of all rules."""
    rng = random.Random(41)
    name = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 2)))
    host = lambda: ".".join(name() for _ in range(rng.randint(1, 9)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 30)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()[: rng.choice([1, 2, 3, 40])]) for _ in range(600))}.values())
    assert len({h.count(".") for _, h, _ in rules}) * len({len(p) for _, _, p in rules}) > 64
    pages = [(i, f"http://{host()}{path()}", "y") for i in range(400)] + [(900, "http://a.b/x", None)] * 3 + [(901, None, "z"), (902, "a.b", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")

    def slow(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h, _, p = rest.partition("/")
        p = "/" + p if "/" in rest else ""
        fit = [(len(x + y), len(x), v, x + y) for v, x, y in rules if h and (h == x or h.endswith("." + x)) and p.startswith(y)]
        return max(fit)[2:] if fit else ("allow", None)

    for chars in (urls.BROADCAST_CHARS, 0):
        monkeypatch.setattr(urls, "BROADCAST_CHARS", chars)
        got = urls.match(df, table).collect()
        assert len(got) == len(pages) and all((r.verdict, r.rule) == slow(r.url) for r in got)


def test_token_files_by_ranges(spark, monkeypatch):
    """Shards read in ranges of a few documents, mapped or not, and string ids refused."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7)) or None) for i in range(40)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted(map(tuple, tokens.round_trip(docs, path, 2).collect()))

    def portions(n):
        monkeypatch.setattr(tokens, "READ_DOCS", n)
        return sorted(map(tuple, tokens.round_trip(docs, path, 2).collect()))

    assert portions(3) == want and [r[0] for r in want] == list(range(40))
    with pytest.raises(TypeError):
        tokens.write_ids(docs.select(F.col("doc_id").cast("string"), "text"), path, 2)


def slow_raw(model, x):
    """A row's raw score by walking every tree."""
    out = []
    for row in x:
        total = model.base
        for splits, values in model.trees:
            k = 0
            for _ in range(model.fit.depth):
                s = splits[k]
                right = s is not None and sum(row[s[0]] > c for c in model.cuts[s[0]]) > s[1]
                k = 2 * k + 1 + right
            total += values[k - (2**model.fit.depth - 1)]
        out.append(total)
    return np.array(out)


def test_boosted_trees():
    """Scores by walking the trees; a first tree's root is the best split by an exhaustive search; loss falls with each tree."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = (x[:, 1] + 0.5 * (x[:, 2] > 0) + rng.normal(size=500) * 0.3 > 0.3).astype(float)
    fit = toxicity.Fit(trees=12, depth=2)
    model = toxicity.Boosted(fit).train(x, y)
    assert np.allclose(model.raw(x), slow_raw(model, x))
    p = y.mean()
    g, h = y - p, np.full(500, p * (1 - p))
    gains = {}
    for j, cuts in enumerate(model.cuts):
        for b, cut in enumerate(cuts):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= fit.least:
                gains[j, b] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    j, b = model.trees[0][0][0]
    assert gains[j, b] == pytest.approx(max(gains.values()))
    losses = []
    for n in range(1, 13):
        part = toxicity.Boosted(fit)
        part.cuts, part.base, part.trees = model.cuts, model.base, model.trees[:n]
        raw = part.raw(x)
        losses.append(np.mean(np.log1p(np.exp(-raw)) * y + np.log1p(np.exp(raw)) * (1 - y)))
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False))


def test_toxicity_query(spark):
    """The registered query: every document, the held-out share of labels predicted well, and scores that mean what they say."""
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    right = np.mean([r.predicted == r.toxic for r in got])
    rank = p.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print(f"held out {len(y)}: accuracy {right:.4f}, area {auc:.4f}, mean score {p.mean():.4f}, share {y.mean():.4f}")
    assert right > 0.97 and auc > 0.95 and abs(p.mean() - y.mean()) < 0.02


@pytest.mark.parametrize("name", ["op2_token_files", "op3_decontaminate", "op4_secret_scan", "op7_quality_rules", "op10_license_scan"])
def test_registered(spark, name):
    """Queries without SQL return their contract's columns, one row per document (op3: per contaminated one)."""
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_token_files": "doc_id start n_tokens ids_crc32",
        "op3_decontaminate": "doc_id items passages",
        "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    }
    got = queries.QUERIES[name](spark, sf)
    assert got.columns == want[name].split()
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    all_ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert ids == all_ids or name == "op3_decontaminate" and 0 < len(ids) < len(all_ids) and set(ids) <= set(all_ids)


def test_chat_ids_of_any_type(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")], "k long, turn int, role string, text string")
    for kind in ("int", "smallint", "string", "decimal(10,0)", "double"):
        got = chat.read_back(chat.format_turns(df.select(F.col("k").cast(kind).alias("conv_id"), "turn", "role", "text")))
        assert got.schema["conv_id"].dataType.simpleString() == kind and sorted((int(float(r.conv_id)), r.n_turns, r.loss_chars) for r in got.collect()) == [(1, 2, 1), (2, 1, 1)]


def test_pipeline_takes_effect(spark, tmp_path):
    """All stages on planted documents with an extra column whose name clashes with the operators' own: junk, copies and benchmark
    passages go, secrets are masked, clean documents are packed whole."""
    import corpus_pipeline

    rng = random.Random(51)
    item = letters(rng, 30)
    clean = [letters(rng, 90) for _ in range(60)]
    texts = [*clean, clean[0], clean[1].replace(clean[1].split()[40], "other"), f"{letters(rng, 40)} {item} {letters(rng, 40)}", "same three words " * 60, None, ""]
    secret = f"{letters(rng, 45)} api_key=abcdefABCDEF123456 {letters(rng, 45)}"
    rows = [(i, t, "en", "s", len(t or ""), "x", 5) for i, t in enumerate([*texts, secret])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, __distance int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert new.columns == docs.columns, name
        docs = new
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "secrets":
            masked = {r.doc_id: r for r in docs.collect()}[66]
            assert "abcdefABCDEF" not in masked.text and masked.n_chars == len(masked.text)
            assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in docs.collect() if r.doc_id < 66)
    assert kept["quality"] == {*range(63), 66}
    assert kept["near_duplicates"] == {*range(60), 62, 66}
    assert kept["decontamination"] == kept["secrets"] == kept["packing"] == {*range(60), 66}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]
