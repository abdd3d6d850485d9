"""Each operator against a brute-force version or an exact round trip, and on awkward rows: nulls in any column, empty and
very long texts, repeated rows, empty tables, extra columns whose names clash."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import chat, decontaminate, licenses, near_dup, packing, quality, queries, secrets, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
GAP = "[^\x20\x09-\x0d]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, label string, rule string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward():
    rng = random.Random(5)
    words = [w + v for w in ("ba", "lo", "mi", "tur", "sé", "ño") for v in ("ra", "ne", "kol", "da", "vi")]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "two words", long, long, *base, *base[:2]]
    texts += [" ".join(["changed" if i == 7 else w for i, w in enumerate(base[0].split())]), base[1].upper()]
    texts += ["the same line\n" * 40, "Released UNDER the MIT License. cc-by-nc 4.0 " + base[2], "日本語 text ⅷ ſecret=" + "x" * 20]
    texts += ['API_KEY: "' + "a1" * 9 + '" AKIA' + "Z9" * 9 + " " + "0123456789abcdef" * 3, "token=short deadbeef", "x" * 30_000, "tab\there  twice \n end ", "<|endoftext|> \\p <|end|> it's"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1"][i % 2], None if i % 4 else 5, i, "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "a text without id", "en", "s1", None, 0, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def ids_of(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(public_tokenizers.path(name))
        odd = ["", " ", "\n", "a  b", "a\n b", "a \nb", " x", "x ", "x\n", "\nx", "a\n\nb", "\r\n", "it's I'LL 's", "Σας ΟΔΟΣ İK", "a\u0338 \u0338b", "\u200b\u180e x", "x\u00a0y", "½²ª 12a", "日本語", "<|endoftext|>", "é" * 90]
        for t in [*odd, *[r[1] or "" for r in awkward()]]:
            assert e.encode(t) == e.whole(t), (name, t[:40])


def test_packing(docs, none):
    rows = awkward()
    ids = dict()
    for r, x in zip(rows, ids_of("word_bpe_49k.json", [r[1] for r in rows], 0), strict=True):
        ids.setdefault(r[0], []).append(x)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    total, bins = 0, defaultdict(list)
    want = Counter((r[0], k, at, zlib.crc32(array("I", x[at : at + 2048]).tobytes())) for r, x in zip(rows, ids_of("word_bpe_49k.json", [r[1] for r in rows], 0), strict=True) for k, at in enumerate(range(0, len(x), 2048)))
    assert Counter((p.doc_id, p.piece, p.start, p.ids_crc32) for p in got) == want
    for p in got:
        assert len(p.ids) == p.length and zlib.crc32(array("I", p.ids).tobytes()) == p.ids_crc32
        bins[p.sequence_id].append((p.offset, p.length))
        total += p.length
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # the third opening closes sequence 2
    assert bins.place(2) == (1, 7)  # the least free space that holds it
    assert bins.place(4) == (0, 6)


def test_token_files(docs, none):
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(tokens.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((r[0], len(x), zlib.crc32(array("I", x).tobytes())) for r, x in zip(rows, ids_of("byte_bpe_50k.json", [r[1] for r in rows], 2), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokens.round_trip(none, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(40))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, None), (3, "", None), (4, "short", None)], "item_id long, text string, doc_id string")
    typos = list(item)
    for at in range(10, len(typos), 40):
        typos[at] = "z"
    texts = {1: f"before {item.upper()}, after", 2: "é " + "".join(typos) + " ½", 3: item[:60], 4: "clean text", 5: item.replace(" ", "\n"), 6: "日本 " + item, 7: None, 8: "short"}
    df = spark.createDataFrame([(k, v, "q") for k, v in texts.items()], "doc_id long, text string, items string")
    found = {r.doc_id: r["__items"] for r in decontaminate.contamination(df, bench).collect()}
    assert set(found) == {1, 2, 5, 6}
    hit = found[1][0]
    assert texts[1][hit.start : hit.end].lower() == item and hit.edits == 0 and hit.item_id == 1
    assert found[2][0].edits > 0
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 7, 8}
    assert decontaminate.contamination(docs, bench).count() == 0 and decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def slow_align(p, t):
    d = [[0] * (len(t) + 1)] + [[i + 1] + [0] * len(t) for i in range(len(p))]
    for i in range(1, len(p) + 1):
        for j in range(1, len(t) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (p[i - 1] != t[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return min(d[-1])


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(150):
        p, t = (rng.integers(0, 3, rng.integers(1, 12)) for _ in range(2))
        best = slow_align(p.tolist(), t.tolist())
        got = decontaminate.align(p, t, 20)
        assert got[0] == best
        assert best == 0 or decontaminate.align(p, t, best - 1) is None
        assert slow_align(p.tolist(), t[got[1] : got[2]].tolist()) == best


def slow_spans(text):
    rules = [("assign", secrets.BASE[0].pattern, 2, 12, re.A | re.I), ("access", "AKIA[A-Z0-9]+", 0, 18, 0), ("hex", "[0-9a-f]+", 0, 16, 0)]
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n, f) in enumerate(rules) for m in re.finditer(p, text, f) if len(m[g]) >= n)


def test_secrets(docs, none):
    def said(spans):
        return ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in spans)

    want = Counter((r[0], said(slow_spans(r[1] or ""))) for r in awkward())
    assert by_row(secrets.scan(docs), "doc_id", "base_spans") == want
    assert any(k[1] for k in want) and secrets.scan(none).count() == 0
    kept = secrets.redact(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    for r in kept.collect():
        assert r.text is None or not slow_spans(r.text)
    clean = {r[0]: r[1] for r in awkward() if r[0] is not None and not slow_spans(r[1] or "")}
    assert all(r.text == clean[r.doc_id] for r in kept.collect() if r.doc_id in clean)


def test_trigram_queries_never_lose_a_match():
    rng = random.Random(4)
    pieces = ["pass", "word", "wd", "secret", "tok", "en", "api", "_", "key", "AKIA", "=", ": ", '"', "a1b2c3d4e5f6", "ghp_", "x" * 40, " ", "-----BEGIN ", "PRIVATE KEY-----", "PaSs"]
    texts = ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(300)]
    rules = secrets.BASE + secrets.MORE
    got = secrets.find_spans(texts, rules)
    for t, spans in zip(texts, got, strict=True):
        want = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t, re.A | (re.I if r.any_case else 0)) if m.end(r.group) - m.start(r.group) >= r.least]
        assert spans == sorted(want)


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|> \\l"), (1, 1, "assistant", "a < b\n\\"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 1, "a|b<", ""), (None, 0, "assistant", "loss"), (1, 1, "assistant", "a < b\n\\"), (-7, 0, "user", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <|image 0|> "), part("image", ref="s3:a", units=2), part("audio", ref="b"), part("text", "end")]), (1, 1, "assistant", [part("document", ref="c", units=3), part("text", "ok <")])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content array<{chat.PART}>")
    first, second = sorted(chat.format_turns(df, "content").collect(), key=lambda r: r.ordinal)
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in [*first.attachments, *second.attachments]] == [(0, "image", "s3:a", 514), (1, "audio", "b", 27), (2, "document", "c", 1540)]
    assert first.formatted == "<|user|>\nsee \\l|image 0|> <|image 0|><|audio 1|>end<|end|>\n" and first.loss_spans == []
    assert [chat.unescape(second.formatted[s.start : s.end]) for s in second.loss_spans] == ["ok <"]


def test_urls(spark):
    rules = urls.RULES
    cases = [None, "", "no scheme", "http://a.Example.NET/en/x", "http://xexample.net/en/", "https://example.com/de/y?q", "http://net/", "http://net", "http://a.org/fr/", "x://a.org?/fr/", "http://ORG/fr/1", "http://a.com/", "http:///net/", "http://.net/a", "http://" + "a." * 200 + "net/" + "b/" * 500]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*cases, cases[3]])], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.match(df, urls.rule_table(spark)).collect()}
    for i, u in enumerate([*cases, cases[3]]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = low(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u
    assert urls.match(df.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.match(df, urls.rule_table(spark).limit(0)).collect()} == {"allow"}


def slow_counts(text):
    w = re.findall(GAP, text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(GAP, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    want = Counter((r[0], *slow_counts(r[1] or "")) for r in awkward())
    judged = quality.judge(docs)
    assert by_row(judged, "doc_id", "__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words") == want
    for r in judged.collect():
        n, repeats = r["__n_words"], r["__n_repeat_words"]
        assert r["__base_failed"] == (n < 50 or 100 * repeats > 50 * n) and (r["__kept"] or r["__base_failed"] or r["__distance"] is not None)
    assert quality.judge(none).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(120))
    rows = [(i, text(), "en", "s") for i in range(300)] + [(1000 + i, " ".join(w + "%%$$" for w in text().split()), "en", "s") for i in range(20)]
    got = {r.doc_id: r["__kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(v == (k < 1000) for k, v in got.items())


def slow_components(rows, k, percent):
    sets = []
    for r in rows:
        w = re.findall(GAP, low(r[1] or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return Counter((r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets, strict=True))


def near_copies(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for c in range([1, 2, 3, 8, 20, 90][g]):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 500, " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = near_copies(k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, near_dup.Similarity(k, percent, small=16)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward(docs, none):
    rows = awkward()
    got = near_dup.near_duplicates(docs, near_dup.Similarity(3, 85)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == slow_components(rows, 3, 85)
    kept = near_dup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and ids.count(None) == 2
    assert near_dup.near_duplicates(none).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(9)
    words = [a + b for a in ("ba", "lo", "mi", "tur") for b in ("ra", "ne", "kol", "da")]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["you", "idiot", "scum", "1d10t", "moron!", "quargel"])
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    model = toxicity.train(df, df)
    out = df.join(toxicity.score(df, model), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    blank = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic long"))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}
    known = toxicity._Kinds({})
    assert [known[t] & 7 for t in ("idiot", "1d10t", "i.d.i.o.t", "id*ot", "idiooot", "YOU,", "fine")] == [1, 2, 2, 2, 2, 3, 0]


def test_isotonic():
    xs, ys = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 4, 5], xs, ys).tolist() == [0, 0.5, 0.5, 1, 1]


def test_licenses(spark, docs, none):
    want = Counter()
    for r in awkward():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(r[1] or ""))
        at, labels = [], set()
        for label, phrase in licenses.PHRASES.items():
            p = phrase.split()
            places = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        want[r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert by_row(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    mit = licenses.TEMPLATES["mit"].split()
    edited = " ".join([*mit[:6], "really", *mit[6:15], *mit[16:]])
    rows = [(1, "x " + licenses.TEMPLATES["mit"] + " y"), (2, edited), (3, " ".join(mit[:5])), (4, "\u212alaus under the mit license under the mit license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].score, got[2].labels, got[3].labels) == ("mit", 1.0, "mit", "")
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 1, 5)
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.select(*columns).fetchall())


def test_pipeline(spark, docs, none):
    """Stage by stage on awkward rows: columns stay, and each stage keeps just what its operator's brute force says."""
    rows = {r[0]: r for r in awkward()}
    df = docs.select("doc_id", "text", "lang", "source", "n_chars")
    steps = dict(corpus_pipeline.STAGES)
    one = steps["quality"](spark, df, SF)
    assert one.columns == df.columns
    ok = lambda t: (c := slow_counts(t or ""))[0] >= 50 and 100 * c[4] <= 50 * c[0]
    assert {r.doc_id for r in one.collect()} == {i for i, r in rows.items() if ok(r[1])}
    two = steps["near_duplicates"](spark, one, SF)
    left = [r for r in awkward() if ok(r[1])]
    assert {r.doc_id for r in two.collect()} == {c for _, _, c in slow_components(left, 5, 80)}
    three = steps["decontamination"](spark, two, SF)
    four = steps["secrets"](spark, three, SF)
    assert four.columns == df.columns and four.count() == two.count()
    assert {r.doc_id for r in steps["packing"](spark, four, SF).collect()} == {r.doc_id for r in four.collect()}
    for f in steps.values():
        assert f(spark, none.select(*df.columns), SF).count() == 0
