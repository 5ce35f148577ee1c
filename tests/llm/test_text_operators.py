"""Quality, secrets, personal data, language: brute force on random texts, edges, small fits."""

import base64
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from corvella.llm import langid, pii, quality, secret_scan
from corvella.llm._shared import Scratch

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PARTS = ["a", ".", "@", "1", "9", "25", "0", "-", "+", " ", "(", ")", "é", "中", "4111 1111 1111 1111", "+1 (212) 555-0000", "1.2.3.4", "token", "=", ":", '"', "secret", "AKIA", "A" * 16, "abcdef0123456789abcdef01", "PassWord", "api_key", "\n", "😀", "ſ"]


def random_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def luhn(s):
    t = 0
    for i, c in enumerate(s[::-1]):
        d = int(c) * (1 + i % 2)
        t += d - 9 if d > 9 else d
    return t % 10 == 0


def test_personal_data_by_brute_force():
    digits = lambda s: re.sub("[^0-9]", "", s)
    for t in random_texts(30000):
        want = [("email", *m.span()) for m in EMAIL.finditer(t)]
        want += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(pii.single_bytes(t)) == want, t


def test_secrets_by_brute_force():
    for t in random_texts(30000):
        want = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda s: (s[0], secret_scan.KINDS.index(s[1])))
        assert [s for s in secret_scan.spans(t) if s[1] in secret_scan.BASE] == want, t


def test_checksums_and_tokens():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secret_scan.base62(zlib.crc32(body.encode()), 6)}"
    assert [s[1] for s in secret_scan.spans(f"x {good} y")] == ["checked"]
    assert not secret_scan.spans(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y")
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    assert [s[1] for s in secret_scan.spans(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.abc")] == ["jwt"]
    assert secret_scan.masked(f"a {good} b", secret_scan.spans(f"a {good} b")) == "a [SECRET] b"


def test_tokens_by_brute_force():
    """Of JWT-like runs those that a plain search finds; in time that grows with the length."""
    head = base64.urlsafe_b64encode(b'{"alg":"x"}').decode().rstrip("=")
    rng, parts = random.Random(4), ["eyJ", ".", head, " ", "a", "-", "EYJ"]
    plain = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [(m.start(), "jwt", m.end()) for m in plain.finditer(t) if secret_scan.jwt_holds(m[1].encode())]
        assert [s for s in secret_scan.spans(t) if s[1] == "jwt"] == want, t
    began = time.perf_counter()
    for long in ("eyJ" * 400_000, "eyJa." * 200_000, "token " * 150_000, "token" + " " * 1_000_000, "AKIA" * 300_000, "ghp_" * 300_000):
        secret_scan.spans(long)
    assert time.perf_counter() - began < 12


def test_contexts_discover_identifiers(spark, table):
    rows = [(i, f"please call our desk hotline number +1 (212) 555-{1000 + i} for help today") for i in range(30)]
    rows += [(100, "please call our desk hotline number 2125557788 for help today"), (101, "an order of 2125557788 pieces"), (102, "a clean text with 1999 in it")]
    found = {r.doc_id: r for r in pii.find(table(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert "ctx_phone:36:46" in found[100].found
    assert found[102].found == "" and found[0].base.startswith("phone:")
    redacted = {r.doc_id: r.text for r in pii.redact(table(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert "2125557788" not in redacted[100] and "555" not in redacted[3] and redacted[102] == rows[-1][1]


def test_contexts_discover_any_shape(spark, table):
    """What no expression finds in the slots of what they find: mail addresses, numbers above 255, grouped digits."""
    slot = {
        "email": ("please write to our mail address {} for an answer", [f"user{i}@mail.example.com" for i in range(20)], ["jane[at]corp.com", "jan\u00e9@corp", "jane.corp.com"]),
        "ip": ("today the main server host {} is down again", [f"10.1.2.{i}" for i in range(20)], ["10.1.2.999", "fe80::1"]),
        "phone": ("please call our desk hotline number {} for help", [f"+1 (212) 555-{1000 + i}" for i in range(20)], ["(212) 555-7788", "212 55 77 88", "212.555.778", "(212)555-7788"]),
        "card": ("this was paid with my card no {} on monday", [c for c in map(str, range(4111111111110000, 4111111111110300)) if luhn(c)][:20], ["4111 1111 1111 1112", "411 111 111 111 2"]),
    }
    rows, want = [], {}
    for k, (text, seeds, unseen) in slot.items():
        rows += [(len(rows) + i, text.format(x)) for i, x in enumerate(seeds)]
        for x in unseen:
            want[len(rows)] = (f"ctx_{k}:{text.index('{')}:{text.index('{') + len(x)}", text.format(f"[{k.upper()}]"))
            rows.append((len(rows), text.format(x)))
    # an ordinary word in a slot is none of these, and none of them is one elsewhere
    plain = len(rows)
    rows += [(plain, slot["email"][0].format("tomorrow")), (plain + 1, slot["phone"][0].format("twelve")), (plain + 2, "about 212 55 77 88 of them at corp.com or 10.1.2.999 there")]
    docs = table(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs, Scratch(spark, "t")).collect()}
    assert {i: (found[i].base, found[i].found) for i in want} == {i: ("", w) for i, (w, _) in want.items()}
    redacted = {r.doc_id: r.text for r in pii.redact(docs, Scratch(spark, "t")).collect()}
    assert {i: redacted[i] for i in want} == {i: w for i, (_, w) in want.items()}
    assert all(found[i].found == "" and redacted[i] == rows[i][1] for i in range(plain, len(rows)))


def test_foldings_hide_nothing():
    """A text that its folding lets pass unsearched holds no hint and no run of digits."""
    rng = random.Random(13)
    for _ in range(40000):
        t = "".join(rng.choice("aZ09_-.:@[]<>(){} é\n/at") for _ in range(rng.randint(0, 9))).encode("latin-1")
        folded = t.translate(pii._FOLD)
        assert any(h in folded for h in pii.HINTS) or not pii._hint.search(t), t
        assert folded.count(b"0") >= 6 or not list(pii.runs(t)), t


def test_words_beside_a_span():
    rng = random.Random(12)
    for _ in range(3000):
        t = "".join(rng.choice(["ab", "C" * rng.choice([1, 60, 300]), " ", " " * rng.choice([1, 70]), "\n", "1", ":"]) for _ in range(rng.randint(1, 12)))
        s, e = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
        word = lambda w: w.lower() if len(w) <= pii.LONGEST else pii.LONG_WORD
        before, behind = t[:s].split(), t[e:].split()
        assert pii.beside(t, s, e) == ([word(w) for w in before[-2:]], word(behind[0]) if behind else None)


def discovered(texts, least_seeds=3, confident=0.8):
    """The learned spans of each text by plain dictionaries."""
    seen = [pii.occurrences(t)[1] for t in texts]
    edge = {}
    for kind, _, _, instance, patterns, may in (o for f in seen for o in f):
        for p in patterns:
            k, m = edge.get((p, instance), (None, None))
            edge[p, instance] = (min(x for x in (k, kind) if x) if k or kind else None, min(x for x in (m, may) if x))
    known = {}
    for (_, i), (k, _) in edge.items():
        if k:
            known[i] = min(k, known.get(i, k))
    while True:
        met = {}
        for p, i in edge:
            met.setdefault(p, []).append(known.get(i))
        scored = {}
        for p, ks in met.items():
            best = max(map(ks.count, pii.KINDS))
            if best >= least_seeds and best >= confident * len(ks):
                scored[p] = (best / len(ks), next(k for k in pii.KINDS if ks.count(k) == best))
        new = {}
        for (p, i), (k, may) in edge.items():
            if k is None and p in scored and scored[p][1] in may and i not in known:
                new[i] = max(new.get(i, scored[p]), scored[p])
        if not new:
            break
        known |= {i: k for i, (_, k) in new.items()}
    out = []
    for f in seen:
        marks = {}
        for kind, s, e, _, patterns, may in f:
            for p in patterns:
                if kind is None and p in scored and scored[p][1] in may:
                    marks[s, e] = max(marks.get((s, e), scored[p]), scored[p])
        out.append(",".join(f"ctx_{k}:{s}:{e}" for k, s, e in sorted(((k, s, e) for (s, e), (_, k) in marks.items()), key=lambda x: (pii.KINDS.index(x[0]), *x[1:]))))
    return out


def test_discovery_by_brute_force(spark, table):
    """Pattern and instance scores over rounds: chains of contexts, each learned from the one before."""
    rng = random.Random(6)
    pool, texts = [f"+1 (212) 555-{1000 + k}" for k in range(8)], []
    for n in range(7):
        pool += [f"212 55 {10 + n} {70 + j}" for j in range(2)]
        texts += [f"step{n} call {x} end{n} {rng.choice(['x', 'y'])}" for x in pool[-10:]]
    texts += [f"{rng.choice(['mail', 'host'])} {rng.choice(['to', 'of='])} {rng.choice(['u%d@mail.org'] * 12 + ['u%d[at]mail'] + ['10.1.%d.7'] * 2)} {rng.choice(['now', 'then', ''])}" % rng.randrange(40) for _ in range(400)]
    texts += ["a" * 400 + " " + "b" * 300 + f" u{i}@mail.org " + "c" * 500 for i in range(4)] + ["a" * 400 + " " + "d" * 300 + " u[at]mail.org " + "e" * 500, None, "", texts[0]]
    want = discovered(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.found for r in pii.find(table(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 20 and sum(map(bool, want[60:70])) == 10
    assert "ctx_email" in want[-4]  # long words of a context are all one


def test_identifiers_of_any_text():
    """In order, apart from each other and from base spans, each of some kind; a run beside a base span stays whole."""
    for t in random_texts(20000):
        raw = pii.single_bytes(t)
        base = pii.base_spans(raw)
        got = pii.identifiers(raw, base)
        assert all(e <= s for (_, e), (s, _) in zip(got, got[1:])), t
        assert all(pii.may_be(raw[s:e]) for s, e in got) and not any(s < y and x < e for s, e in got for _, x, y in base), t
    at = lambda t: [t[s:e] for s, e in pii.identifiers(pii.single_bytes(t), pii.base_spans(pii.single_bytes(t)))]
    assert at("call (212) 555-7788 1.2.3.4, tel:(212) 555-7789; or 2125557788.") == ["(212) 555-7788", "(212) 555-7789", "2125557788"]
    assert at("in 12 of 34 cases, 1999 at x-12345 and a.b1234") == ["1999", "x-12345", "a.b1234"]
    assert at("1 " * 40000 + "x" * 100_000 + "1." * 50_000 + "12345") == []


def test_edges(spark, edges, empty):
    held = F.lit(False)
    nothing = hashlib.sha256(b"").hexdigest()
    for docs, n in ((edges, 8), (empty, 0)):
        scanned = secret_scan.scan(docs).collect()
        assert len(scanned) == n and all(r.base_sha256 == nothing for r in scanned if r.doc_id != 6 and r.doc_id != 7)
        assert pii.find(docs, Scratch(spark, "t")).count() == n
        assert sorted(pii.redact(docs, Scratch(spark, "t")).collect(), key=str) == sorted(docs.collect(), key=str)
        model = langid.fit(docs)
        out = langid.predict(docs, model, held).collect()
        assert len(out) == n and all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (3, 4, 5))
        assert quality.scores(docs, None, held).count() == n
        assert quality.score(docs, None).count() == n


def test_languages_are_told_apart(table):
    rng = random.Random(2)
    words = {"aa": ["bada", "gado", "dabo", "goda"], "bb": ["kilt", "stik", "tulk", "skit"]}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = langid.fit(table([(i, text(k, 50), k) for i, k in enumerate(["aa", "bb"] * 20)], "doc_id long, text string, lang string"))
    pure, n = langid.identify(text("bb", 80), model[1])
    assert pure == {1: 1.0} and n == 80
    mixed, _ = langid.identify(text("aa", 60) + " " + text("bb", 40), model[1])
    assert set(mixed) == {0, 1} and abs(mixed[0] - 0.6) < 0.1


def test_shares_by_brute_force():
    """Expectation-maximisation comes to the shares of largest likelihood on a fine grid."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        like = np.exp(rng.normal(size=(60, 2)) * 2)
        share = langid.mixture(like / like.max(axis=1, keepdims=True), steps=500, tolerance=1e-9)
        grid = np.linspace(0, 1, 2001)
        best = grid[np.argmax(np.log(np.maximum(like @ np.stack([grid, 1 - grid]), 1e-300)).sum(axis=0))]
        assert abs(share[0] - best) < 2e-3


def test_sample_of_languages(table):
    """The model counts the trigrams of the texts of smallest hash of each language, each once."""
    texts = {k: [f"{k}{i} {k * 3} word{i}" for i in range(30)] for k in ("aa", "bb")}
    rows = [(i, t, k) for k in texts for i, t in enumerate(texts[k] * 3)] + [(1, None, "aa"), (2, "x", None)]
    docs = table(rows, "doc_id long, text string, lang string")
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    langs, logp = langid.fit(docs, per_lang=7, smooth=0.5)
    assert langs == ["aa", "bb"]
    for j, k in enumerate(langs):
        c = np.zeros(1 << langid.BITS)
        for t in sorted(texts[k], key=hashes.get)[:7]:
            c += np.bincount(langid.trigrams(t)[0], minlength=1 << langid.BITS)
        assert np.allclose(logp[:, j], np.log((c + 0.5) / (c.sum() + 0.5 * (1 << langid.BITS))), atol=1e-5)


def test_quality_is_learned(spark, table, edges, empty):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "meadow", "quiet"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["$$$", "###x", "buy!!", "%%%"]) + rng.choice("qwz") for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    docs = table(rows, "doc_id long, text string")
    labels = table([(i, int(i % 3 > 0), 0) for i in range(0, 200)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scores(docs, model, F.lit(False)).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300)]) > 0.97
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(docs, model).columns == ["doc_id", "text", "quality_score"]
    for more, n in ((edges, 8), (empty, 0)):
        out = quality.scores(more, model, F.lit(False)).collect()
        assert len(out) == n and all(0 <= r.score <= 1 for r in out) and all(r.score == model.prior for r in out if r.doc_id in (3, 4))
        assert quality.score(more, model).columns == [*more.columns, "quality_score"]
        assert quality.fit(more, labels.where("quality = 1")) is None


def test_sizes_by_brute_force(spark, table):
    """Scores are those of the pieces compressed one by one with plain zstandard."""
    import zstandard

    rows = [(i, f"quiet river {i} " * (40 * i)) for i in range(1, 9)] + [(i, f"$$$ buy!! {i} ### " * (40 * i)) for i in range(9, 17)]
    docs, labels = table(rows, "doc_id long, text string"), table([(i, int(i < 9)) for i in range(1, 17)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.scores(docs, model, F.lit(False)).collect()}
    for i, t in rows:
        raw, size = t.encode(), []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            size.append(sum(len(c.compress(raw[k : k + model.piece])) for k in range(0, len(raw), model.piece)))
        x = quality.features(np.array(size[:1]), np.array(size[1:]), np.array([len(raw)]))
        assert abs(got[i] - 1 / (1 + np.exp(-(x @ np.array(model.weights))[0]))) < 1e-9


def test_calibration_comes_to_rest():
    """On separable classes, with features of any scale, no gradient is left."""
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1, 1e3):
        x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 4)) * [scale, 1, 1, 1e-4]], axis=1)
        y = (x[:, 1] > 0).astype(float)
        w = quality.logistic(x, y)
        p = 1 / (1 + np.exp(-x @ w))
        assert np.isfinite(w).all() and ((p > 0.5) == y).mean() > 0.97 and abs(p.mean() - y.mean()) < 1e-3


def test_copies_of_an_id_crowd_no_one_out(table):
    """A labelled id with very many texts counts once, and the choice does not depend on partitions."""
    rows = [(1, f"quiet meadow river number {i} " * 20) for i in range(400)]
    rows += [(i, f"stone cloud {i} and a quiet river {i} " * 20) for i in range(2, 6)] + [(i, f"buy!! $$$ {i} ###x {i} %%% " * 20) for i in range(6, 11)]
    labels = table([(i, int(i < 6), 0) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    fitted = [quality.fit(table(part, "doc_id long, text string", parts), labels, per_class=5) for part, parts in ((rows, 1), (rows[::-1], 1), (rows, 3))]
    assert all(m is not None and m.prior == 0.5 and m == fitted[0] for m in fitted)
