"""Each operator against a brute-force version on a small table with nulls, empty, long and repeated texts."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import decontaminate, exact_dedup, langid, licenses, mixing, pii, quality, queries, simhash, token_files, url_filter

AZ = {c: c + 32 for c in range(65, 91)}
EN = "the cat sat on the mat and looked at the dog while rain fell over the old stone bridge near town".split()
DE = "der hund und die katze schlafen nicht weil das wetter über der alten straße schön geworden ist".split()
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, digest string, fp string, key string, hit int, _text int"


def _rows():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(EN if i % 2 else DE, k=rnd.randint(1, 60))) for i in range(40)]
    texts += [texts[3].upper(), texts[3], texts[5] + " end", None, "", " \n\t ", "ÀÉ mixed É", "àé mixed é", "1234 !!", "word " * 40_000, "Intro. " + ITEM.title() + "! " + "tail " * 30]
    rows = [(i, t, ("en" if i % 2 else "de") if i < 40 else None, f"src{i % 4}" if i % 7 else None, len(t or ""), "x", "y", "z", "k", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[3], None, None, 0, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(found):
    return sorted(map(tuple, found), key=repr)


def _exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(AZ), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def test_exact_dedup(docs, rows, empty):
    assert _sorted(exact_dedup.exact_dedup(docs).collect()) == _sorted(_exact(rows))
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_compares_contents(docs, rows):
    """Different texts with one digest stay apart."""
    weak = exact_dedup.exact_dedup(docs, digest=lambda norm: F.pmod(F.length(norm), F.lit(3)))
    assert _sorted(weak.collect()) == _sorted(_exact(rows))


def _simhash(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _least(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows, empty):
    fps = {r[1]: _simhash(r[1]) for r in rows}
    classes = _least(range(len(rows)), lambda i, j: (fps[rows[i][1]] ^ fps[rows[j][1]]).bit_count() <= 2)
    least = {}
    for i, c in classes.items():
        if rows[i][0] is not None:
            least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    want = [(r[0], f"{fps[r[1]]:016x}", least.get(classes[i])) for i, r in enumerate(rows)]
    assert _sorted(simhash.near_duplicates(docs).collect()) == _sorted(want)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n,radius", [(2, 2), (63, 1), (64, 3), (700, 2), (1, 2)])
def test_bit_sliced_comparison(n, radius):
    rnd = random.Random(n)
    fps = list({rnd.getrandbits(64) for _ in range(n)})
    for _ in range(n // 2):
        fps.append(rnd.choice(fps) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    fps = sorted(set(fps))
    a, b = simhash.forest(np.array(fps, np.uint64), radius)
    got = _least(fps, lambda x, y, e=set(zip(a.tolist(), b.tolist())): (x, y) in e)
    assert got == _least(fps, lambda x, y: (x ^ y).bit_count() <= radius)
    assert len(a) < max(1, len(fps))


def test_simhash_links_across_cells(spark):
    """A key with more fingerprints than a cell holds is split, and no link is lost."""
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    fps = sorted({centre ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 3))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    edges = {(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in simhash.links(df, 2, cell=16).collect()}
    assert _least(fps, lambda x, y: (x, y) in edges) == _least(fps, lambda x, y: (x ^ y).bit_count() <= 2)


def test_components(spark):
    from corpuslab.llm.components import components

    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (500, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 500: 100}


def _joined(edges):
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return {x: find(x) for x in label}


def test_components_work_on_the_edges_left(spark, monkeypatch):
    """A round reads the edges that are left, not all again, and what is known is not worked on twice."""
    from corpuslab.llm import components as module

    rnd = random.Random(5)
    dense = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(400)] + [(50 + i, 51 + i) for i in range(60)] + [(7, 7), (200, 200)]
    kept: list[tuple[str, int]] = []
    stage = module.stage

    def counted(df, name):
        made = stage(df, name)
        kept.append((name, made.count()))
        return made

    monkeypatch.setattr(module, "stage", counted)
    frame = spark.createDataFrame([*dense, (None, 3), (4, None)], "a long, b long")
    known = module.extended(None, frame)
    assert dict(map(tuple, known.collect())) == _joined(dense)
    edges = [n for name, n in kept if name == "edges"]
    assert len(edges) > 1 and edges[-1] == 0 and sum(edges[1:]) < edges[0]

    kept.clear()
    again = module.extended(known, frame.where("a is not null and b is not null"))
    assert [n for name, n in kept if name == "edges"] == [] and again.count() == known.count()

    more = [(45, 30), (45, 110), (300, 301), (200, 301), (2, 3)]
    got = module.extended(known, spark.createDataFrame(more, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(_joined(dense + more).items())
    assert max(n for name, n in kept if name == "edges") <= 4


def _fill(budget, children):
    """Budgets of (weight, capacity) children: rounds in which the full ones leave."""
    left, rest, out = dict(enumerate(children)), budget, {}
    while left:
        total = sum(w for w, _ in left.values())
        full = [i for i, (w, c) in left.items() if c * total <= rest * w]
        if not full:
            out |= {i: min(c, rest * w // total) for i, (w, c) in left.items()}
            break
        for i in full:
            out[i] = left.pop(i)[1]
            rest -= out[i]
    return [out[i] for i in range(len(children))]


def test_mixing(spark, docs, rows, empty):
    weights = {"a": 3, "a/en": 2, "b/de": 4}
    domain = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")
    got = mixing.plan_mixture(docs, domain, weights, max_epochs=2).collect()
    size = {}
    for r in got:
        size[r.domain, r.lang, r.source] = size.get((r.domain, r.lang, r.source), 0) + r.n_tokens
    budgets = {(): min(sum(size.values()), 2 * sum(size.values()))}
    for level in range(3):
        for parent in [p for p in budgets if len(p) == level]:
            children = sorted({k[: level + 1] for k in size if k[:level] == parent})
            caps = [2 * sum(v for k, v in size.items() if k[: level + 1] == c) for c in children]
            budgets |= dict(zip(children, _fill(budgets[parent], [(weights.get("/".join(c), 1), x) for c, x in zip(children, caps)])))
    for leaf, tokens in size.items():
        mine = [r for r in got if (r.domain, r.lang, r.source) == leaf]
        full = budgets[leaf] // tokens if tokens else 1
        part = budgets[leaf] - full * tokens if tokens else 0
        key = lambda r, full=full: (hashlib.md5(f"17:{full}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id is not None, r.n_tokens)
        for r in sorted(mine, key=key):
            assert (r.full_epochs, r.part_tokens) == (full, min(r.n_tokens, part))
            part -= r.part_tokens
    assert len(got) == len(rows)
    assert mixing.plan_mixture(empty, domain, weights).count() == 0


def test_mixing_names_with_slashes(spark):
    """Names that give the same path when joined are nodes of their own; weights name them with ``\\/``."""
    leaves = [("a", "b/c", "s"), ("a/b", "c", "s"), ("a", "b", "c/s"), ("a/b/c", "s", ""), ("a\\", "/b", "s")]
    rows = [(i, "w " * (10 + i), lang, source, domain) for i, (domain, lang, source) in enumerate(leaves * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, d string")
    got = mixing.plan_mixture(docs, F.col("d"), {"a\\/b": 5, "a": 1}, budget=500, max_epochs=3).collect()
    assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows)
    taken = {}
    for r in got:
        taken[r.domain] = taken.get(r.domain, 0) + r.taken_tokens
    assert 490 <= sum(taken.values()) <= 500 and taken["a/b"] > 4 * taken["a"]


def test_mixing_copies_and_cuts(spark):
    docs = spark.createDataFrame([(i, " a  b\nc d " * 5, "en", "s", 50, "k") for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long, _mix string")
    plan = mixing.plan_mixture(docs, F.lit("d"), budget=250)
    out = mixing.mix(docs, plan).collect()
    assert sum(len(r.text.split()) for r in out) == 250 and list(out[0].asDict()) == docs.columns
    cut = [r for r in out if len(r.text.split()) < 20]
    assert len(cut) == 1 and docs.first().text.startswith(cut[0].text) and cut[0].n_chars == len(cut[0].text)


def test_mixing_same_at_every_bucket_count(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod(F.col("id"), F.lit(7)).cast("int")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    plan = mixing.plan_mixture(docs, F.lit("d"), budget=5000).collect()
    assert sum(r.taken_tokens for r in plan) == 5000 and sum(0 < r.part_tokens < r.n_tokens for r in plan) <= 1


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = token_files.default_tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    shards = token_files.write_token_files(docs, path, folder=str(tmp_path), seq_len=64, shard_bytes=20_000)
    want, ids = [], []
    encoded = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    for doc_id, x in sorted(encoded, key=lambda e: (e[0] is not None, e[0] or 0, np.array(e[1], "<u2").tobytes())):
        want.append((doc_id, len(ids), len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        ids += x
    got = token_files.read_token_files(shards).drop("shard").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    listed = shards.orderBy("shard").collect()
    assert len(listed) > 2
    stream = []
    for s in listed:
        f = token_files.TokenFile(s.path)
        for i in range(len(f)):
            seq, mask = f.sequence(i), np.array(f.mask(i))
            assert len(seq) == len(mask) == 64 and not seq.flags.owndata and (mask.all() or i == len(f) - 1)
            stream += seq[mask].tolist()
    assert stream == ids
    assert token_files.read_token_files(token_files.write_token_files(empty, path, folder=str(tmp_path / "none"))).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    tok, enc, rnd = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(3)
    assert enc.chunked
    parts = ["a", "É", "ß", "\n", " ", "  ", "\t", "'s", "'LL", "23", ".", "!?", "\r\n", "×", "ſ", "\x0b", " the", "中", "<|endoftext|>", "_", "\x7f", "\x1c"]
    for i in range(4000):
        text = "".join(rnd.choices(parts if i % 2 else parts[:6] + [" "] * 4 + parts[7:12], k=rnd.randint(0, 16)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids, text


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def _base(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m[0])] for k, p in BASE.items()}


def test_pii_base_spans():
    rnd = random.Random(2)
    parts = ["a", "@", ".", "-", "_", "+", "1", "2", "255", "0000", "4242424242424242", " ", "(", ")", "%", "é", "１", "b.c"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        assert pii.detect(text) == _base(text), text
        found = pii.find(text)
        assert all(s in found["spans"] for s in found["base"])


@pytest.mark.parametrize("text,kind,span", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("write to jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
    ("at john dot doe at example dot com.", "email", "john dot doe at example dot com"),
    ("call plus four one five five five five zero one two three ok", "phone", "plus four one five five five five zero one two three"),
    ("４２４２ ４２４２ ４２４２ ４２４２", "card", "４２４２ ４２４２ ４２４２ ４２４２"),
    ("zero-width ab@c\u200b.de", "email", "ab@c\u200b.de"),
])
def test_pii_disguises(text, kind, span):
    found = pii.find(text)["spans"]
    assert (kind, span) in [(s["kind"], text[s["start"] : s["end"]]) for s in found]


def _strange(text, zero):
    return "".join(chr(zero + int(c)) if c.isdigit() else c for c in text)


@pytest.mark.parametrize("text,kind", [
    ("192 point 168 point 0 point 1", "ip"), ("10 POINT 0 dot 0 point 7", "ip"), ("jane@sıte.com", "email"),
    *((_strange("4242 4242 4242 4242", zero), "card") for zero in (0x6F0, 0x660, 0x966, 0x9E6, 0xE50, 0xFF10, 0x1D7D8)),
    *((_strange("+49 151 2345678", zero), "phone") for zero in (0x6F0, 0x966)),
    ("".join("⁰¹²³⁴⁵⁶⁷⁸⁹"[int(c)] for c in "4242424242424242"), "card"), ("".join("⓪①②③④⑤⑥⑦⑧⑨"[int(c)] for c in "4242424242424242"), "card"),
    ("ℐane@ℋost.com", "email"), ("jane﹫host.com", "email"), ("4242\u00a04242\u00a04242\u00a04242", "card"),
])
def test_pii_plain_disguises_without_other_hints(text, kind):
    assert [(s["kind"], s["start"], s["end"]) for s in pii.find(text)["spans"]] == [(kind, 0, len(text))]


def test_pii_prefilter_drops_nothing(monkeypatch):
    """find() finds the same if every text goes through all transducers."""
    rnd = random.Random(12)
    parts = ["one", "two", "Five", "sıx", "ſeven", "fİve", "4242424242424242", "1", "25", "0", " ", " ", " ", "-", ".", "@", " @ ", " at ", " dot ", " point ", "[at]", "(dot)", "{ . }",
             "plus ", "+", "a", "host", "com", "٣", "۴", "४", "²", "①", "ℋ", "é", "ß", "中", "\u00a0", "\u200b", "‐", "。", "＠", "а"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(30_000)]
    texts += [f"4242 4242 4242 424{chr(c)}" for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000]
    found = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "rewrite", lambda text: pii.at_dot(pii.spelled_digits(every(pii.Rewritten.of(text)))))

    def every(r):
        return r.replace([(i, i + 1, pii.plain_char(c)) for i, c in enumerate(r.text) if not c.isascii()])

    for text, got in zip(texts, found):
        assert got == pii.find(text), text


def test_pii_in_long_texts_takes_linear_time():
    import time

    began = time.time()
    for text, n in (("a@b.co " * 150_000 + "x(at)y.org", 150_001), ("x at y dot org " * 70_000, 70_000), ("x dot " * 150_000 + "y at z dot org", 1)):
        assert sum(s["kind"] == "email" for s in pii.find(text)["spans"]) == n
    assert time.time() - began < 60


def test_pii_whole_name_of_many_parts():
    for name in ("john dot paul dot smith", "a dot b", "j.p dot smith"):
        text = f"mail {name} at example dot com now"
        assert [(s["start"], s["end"]) for s in pii.find(text)["spans"]] == [(5, 5 + len(name) + len(" at example dot com"))]


def test_pii_leaves_clean_texts_alone(spark, docs, rows, empty):
    for text in ("We met at noon; look at the dot.", "Москва и Ελλάδα", "one two three", "the one at example.com", "v1.2.3 of 10 - 20"):
        assert pii.find(text)["spans"] == []
    out, c = pii.find_pii(docs)
    assert out.count() == len(rows) and out.columns[:-1] == docs.columns and c not in docs.columns
    assert pii.find_pii(empty)[0].count() == 0
    df = spark.createDataFrame([("x a@b.com, 1.2.3.4",), (None,)], "text string")
    assert [r.text for r in pii.redact(df).collect()] == ["x [email], [ip]", None]


def test_urls(spark):
    urls = ["http://A.org/x?y", "http://www.example.org/es/1", "https://example.org/en/12#t", "http://s.com/fr/", "http://s.com/de/", "http://t.s.com/en/",
            "nothing", None, "x://lone.net", "http://bad.net/q", "http://s.com/de/2", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, '<a href="http://bad.net/">' if u and "/de/" in u else '<a href="//s.com/de/">' if u and "bad" in u else None, "h") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.org", "/x", "org/"), ("www.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("s.com", "/fr/", "com/fr/"),
        ("s.com", "/de/", "com/de/"), ("t.s.com", "/en/", None), ("", "", None), ("", "", None), ("lone.net", "", None), ("bad.net", "/q", None),
        ("s.com", "/de/2", "com/de/"), ("example.org:80", "/es/", None)]
    assert [got[i].verdict for i in (0, 1, 3, 4, 6, 8)] == ["allow", "block", "allow", "block", "allow", "allow"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_pagerank_reaches_its_limit(spark):
    links = [("a", "b", 1), ("a", "c", 3), ("b", "a", 1), ("c", "c2", 1), ("c2", "a", 2)]
    got = {r.host: r["rank"] for r in url_filter.personalised_pagerank(spark.createDataFrame(links, "src string, dst string, n long"),
                                                                    spark.createDataFrame([("a", 0.75), ("c", 0.25)], "host string, mass double")).collect()}
    names = ["a", "b", "c", "c2"]
    m = np.zeros((4, 4))
    for s, d, n in links:
        m[names.index(d), names.index(s)] = n / sum(x for y, _, x in links if y == s)
    d = url_filter.DAMPING
    want = np.linalg.solve(np.eye(4) - d * m, (1 - d) * np.array([0.75, 0, 0.25, 0]))
    assert np.abs(np.array([got.get(n, 0) for n in names]) - want).sum() < url_filter.ERROR


def test_verdicts_hold_for_far_and_faint_hosts(spark):
    """The same neighbourhood is judged alike beside few or many seed pages, and at any distance."""
    chain = [f"c{i}" for i in range(26)]
    links = [*((a, b, 1) for a, b in zip(chain, chain[1:])), ("faint", "mid", 1), ("other", "mid", 999), ("mid", "bad", 1), ("more", "bad", 999),
             ("tie", "p", 1), ("p", "tie", 1)]
    names = sorted({h for a, b, _ in links for h in (a, b)})
    m = np.zeros((len(names), len(names)))
    for s, d, n in links:  # against the links
        m[names.index(s), names.index(d)] = n / sum(x for _, y, x in links if y == d)
    for many in (1, 10**12):
        blocked = {chain[-1]: 1, "bad": 1, "p": 1, "lone": many}
        seeds = [(h, 0, n) for h, n in blocked.items() if h != "p"] + [("p", 1, 1), ("lone2", sum(blocked.values()) - 1, 0)]
        got = {r.host: r for r in url_filter.host_verdicts(spark.createDataFrame(links, "src string, dst string, n long"),
                                                           spark.createDataFrame(seeds, "host string, trusted long, blocked long")).collect()}
        assert {got[h].verdict for h in (*chain, "faint", "mid", "bad")} == {"block"} and got["tie"].verdict == got["p"].verdict == "allow"
        d = url_filter.DAMPING
        mass = np.array([blocked.get(h, 0) / sum(blocked.values()) for h in names])
        want = np.linalg.solve(np.eye(len(names)) - d * m, (1 - d) * mass)
        assert all(abs(got[h].distrust - w) <= 2 * url_filter.ERROR * w for h, w in zip(names, want) if w > 0)


def test_quality_sample(spark, monkeypatch):
    """The rows learned from are the first by hash, repeated ones included, whatever the sample's size."""
    width = len(quality.STATISTICS)
    rows = [(i % 700 if i % 3 else 7, [float(i)] * width) for i in range(2000)]
    stats = spark.createDataFrame(rows, "doc_id long, x array<double>").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 700, 2)] + [(7, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(sorted(zip(y.tolist(), x[:, 0].tolist()))))
    joined = stats.join(labels, "doc_id").select(F.xxhash64("doc_id").alias("h"), F.col("quality").cast("double").alias("y"), F.col("x")[0].alias("x0")).collect()
    ordered = sorted((r.h, r.y, r.x0) for r in joined)
    for sample in (0, 1, 40, 900, 10_000):
        quality.train(stats, labels, F.lit(True), sample)
        assert seen.pop() == sorted((y, x) for _, y, x in ordered[:sample])


def test_quality(spark, empty):
    rnd = random.Random(4)
    good = [" ".join(rnd.choices(EN, k=30)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(x.upper() + "!!" for x in rnd.choices(EN, k=30)) for _ in range(150)]
    rows = [(i, t, len(t)) for i, t in enumerate(good + bad)] + [(900, None, 0), (901, "", 0), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x long")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    learn = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r for r in quality.score_quality(docs, labels, learn).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == int(i < 150) for i in range(0, 300, 5)]) > 0.95
    one = quality.score_quality(docs, labels.limit(0), learn).collect()
    assert {r.score for r in one} == {0.5}
    assert quality.score_quality(empty, labels, learn).count() == 0


def test_flattened_trees_walk_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.random((500, 6))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    trees = quality.fit(x, y)

    def walk(row):
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if row[trees.feature[t, node]] > trees.cut[t, node] else 1)
            total += trees.leaf[t, node - (2**quality.DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))


def _windows(items, text, size=13):
    w, hit, met = _words(text), set(), set()
    for ident, item in items:
        v = _words(item)
        k = min(size, len(v))
        runs = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in runs:
                hit.update(range(i, i + k))
                met.add("" if ident is None else str(ident))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [3, 1000])
def test_decontamination(spark, docs, rows, empty, block_words):
    items = [(1, ITEM), (2, ITEM.upper() + " extra words"), (10, "Schön geworden"), (11, "the"), (12, ""), (13, None), (None, "rain fell")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out, c = decontaminate.mark(docs, bench, block_words=block_words)
    got = out.select("doc_id", "text", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", f"{c}.items_sha256", f"{c}.contaminated").collect()
    assert _sorted(got) == _sorted([(r[0], r[1], *_windows(items, r[1])) for r in rows])
    assert decontaminate.mark(empty, bench)[0].count() == 0
    none = decontaminate.decontaminate(docs, bench.limit(0))
    assert none.count() == len(rows) and none.columns == docs.columns


def test_decontamination_blocks_are_bounded(spark, tmp_path, monkeypatch):
    """However long an item, no worker holds more than a block's words, and nothing is broadcast."""
    rnd = random.Random(11)
    long = [f"w{i}" for i in rnd.choices(range(300), k=400)]
    items = [("long", " ".join(long)), ("a", " ".join(long[50:70])), ("b", "short one"), (None, " ".join(long[:13]))]
    texts = [" ".join(["x", *long[i : i + n], "y"]) for i, n in ((0, 400), (37, 13), (38, 12), (200, 30), (387, 13), (45, 30))] + ["a short one", None, ""]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def refuse(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    for block_words in (20, 100_000):
        path, blocks = decontaminate.write_blocks(bench, 13, block_words)
        sizes = [sum(decontaminate.held(path, b, 13).auto.sizes) for b in blocks]
        assert len(decontaminate._held) == 1 and max(sizes) <= block_words + 12 and (len(blocks) > 10) == (block_words == 20)
        docs = spark.createDataFrame(list(enumerate(texts)), "_row long, hit string")
        out, c = decontaminate.mark(docs, bench, text_col="hit", columns=["_row"], block_words=block_words)
        got = out.select("_row", f"{c}.n_words", f"{c}.n_hit", f"{c}.n_items", f"{c}.items_sha256", f"{c}.contaminated").collect()
        assert _sorted(got) == _sorted([(i, *_windows(items, t)) for i, t in enumerate(texts)])


def test_windows_of_random_texts():
    rnd = random.Random(9)
    for _ in range(300):
        items = [(i, " ".join(rnd.choices("ab", k=rnd.randint(0, 8)))) for i in range(rnd.randint(0, 5))]
        text = " ".join(rnd.choices("abc", [5, 5, 1], k=40))
        windows = decontaminate.Windows([(str(i), t.encode()) for i, t in items], 4)
        got = decontaminate._judge(text.encode(), [windows], 20)
        assert (got["n_words"], got["n_hit"], got["n_items"], got["items_sha256"], got["contaminated"]) == _windows(items, text, 4)


def test_licences(docs, rows, empty):
    got = licenses.licences()
    rnd = random.Random(8)
    parts = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "é", "GNU General Public License", "The MIT License,"]
    for _ in range(400):
        text = " ".join(rnd.choices(parts, k=rnd.randint(0, 25)))
        w, places = _words(text), []
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        r = got.scan(text.encode())
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    for label, text in licenses.TEMPLATES.items():
        half = " ".join(text.split()[: len(text.split()) * 3 // 4])
        assert label in got.scan(f"some code {half} more code".encode())["labels"].split(",")
    assert got.scan(" ".join(EN).encode())["labels"] == "" and 0 <= got.scan(b"mit license")["score"] <= 1
    out, _ = licenses.scan_licences(docs)
    assert out.count() == len(rows) and licenses.scan_licences(empty)[0].count() == 0


def test_licence_fragments_do_not_hide_a_notice():
    """A late fragment before a whole notice leaves the notice as it is; a run that stands twice counts at both places."""
    got = licenses.licences()
    for label, text in licenses.TEMPLATES.items():
        w = text.split()
        for cut in range(1, len(w) - licenses.LEAST_MATCH):
            for fragment in (w[cut:], w[cut : cut + licenses.LEAST_MATCH + 3]):
                for gap in ("", "x y z"):
                    found = got.scan(" ".join([*fragment, gap, text]).encode())
                    assert label in found["labels"].split(",") and any(s["label"] == label and s["covered"] == 1 for s in found["spans"])
    twice = "one two three four five six A B C D E F one two three four five six G H I J K L"
    own = licenses.Licences({}, {"t": twice})
    for text, spans in ((twice, [(0, 24, 1.0)]), ("A B C D E F x one two three four five six x G H I J K L", [(0, 20, 18 / 24)]),
                        (f"{twice} {twice}", [(0, 24, 1.0), (24, 48, 1.0)]), (f"A B C D E F x {twice}", [(7, 31, 1.0)])):
        assert [(s["start"], s["end"], s["covered"]) for s in own.scan(text.encode())["spans"]] == spans


def test_licence_matches_of_each_template_alone(monkeypatch):
    """Every longest match of a template, at every place, as a comparison word by word finds it: none hides another."""
    rnd, least = random.Random(12), licenses.LEAST_MATCH
    for size in (1, 2, 4):
        for _ in range(60):
            templates = {str(i): " ".join(rnd.choices("abc", [6, 3, 1], k=rnd.randint(1, 30))) for i in range(size)}
            w = rnd.choices("abcx", [6, 3, 1, 0.3], k=rnd.randint(0, 60))
            own, got = licenses.Licences({"c a": "phrase"}, templates), []
            monkeypatch.setattr(own, "_chains", lambda parts: got.extend((str(k - 1), s, e, p) for k, ms in parts.items() for s, e, (p,) in ms) or [])
            own.scan(" ".join(w).encode())
            want = []
            for label, text in templates.items():
                t = text.split()
                for i, j in itertools.product(range(len(w)), range(len(t))):
                    if w[i] == t[j] and not (i and j and w[i - 1] == t[j - 1]):
                        n = next((k for k in range(len(w)) if i + k == len(w) or j + k == len(t) or w[i + k] != t[j + k]), len(w))
                        want += [(label, i, i + n, j + n)] * (n >= least)
            assert sorted(got) == sorted(want)
    own = licenses.Licences({}, {"A": "p q r s t u v w a b c d e f", "B": "a b c d e f g h"})
    for text, start in (("a b c d e f", 0), ("w a b c d e f", 1), ("s t u v w a b c d e f", 5), ("w a b c d e f g h", 1)):
        assert (start, "B") in [(x["start"], x["label"]) for x in own.scan(text.encode())["spans"]]


def test_best_chains_cover_most():
    rnd = random.Random(6)
    for _ in range(400):
        starts = sorted(rnd.sample(range(60), rnd.randint(1, 6)))
        matches, end = [], 0
        for s in starts:
            end = max(end + 1, s + rnd.randint(5, 9))
            matches.append((s, end, sorted({(end - s) + rnd.randint(0, 30) for _ in range(rnd.randint(1, 2))})))
        most = 0
        placed = [[(s, e, b - (e - s), b) for b in ends] for s, e, ends in matches]
        for pick in itertools.product(*([None, *p] for p in placed)):
            chain = [p for p in pick if p]
            if all(x[2] < y[2] and x[3] < y[3] and y[0] <= x[1] + licenses.GAP for x, y in zip(chain, chain[1:])):
                most = max(most, len({i for _, _, a, b in chain for i in range(a, b)}))
        spans = sorted(licenses.best_chains(matches, 1))
        assert max(c for _, _, c in spans) == most and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_language_likelihood_sums_all_segmentations():
    grid = langid.lattice(langid.default_vocabulary())
    prob = langid._smooth(np.random.default_rng(1).random(grid.size), grid)

    def ways(w, i=0):
        if i == len(w):
            yield []
        for j in range(i + 1, len(w) + 1):
            piece = grid.ids.get(w[i:j], grid.unknown if j == i + 1 else None)
            if piece is not None:
                yield from ([piece, *rest] for rest in ways(w, j))

    words = ["the", "straße", "étre", "中文", "x", "thethe", "professional", "technologies"]
    assert {"▁professional", "▁technologies"} <= set(grid.ids)
    sums = [sum(np.prod(prob[s]) for s in ways("▁" + w)) for w in words]
    assert np.allclose(langid.log_likelihood(prob[:, None], grid, words)[:, 0], np.log(sums))
    want = np.zeros(grid.size)
    for w, total in zip(words, sums):
        for s in ways("▁" + w):
            np.add.at(want, s, np.prod(prob[s]) / total)
    assert np.allclose(langid.expected_counts(prob, grid, words, np.ones(len(words))), want)


def test_long_words_of_an_unlearned_script():
    """Sums stay in range at any length and any amount of learned text, and no language wins by its size."""
    grid = langid.lattice(langid.default_vocabulary())
    rnd = np.random.default_rng(3)
    counts = np.column_stack([rnd.random(grid.size) * n / grid.size for n in (1e3, 1e9, 1e9)])
    model = langid.Model(langid.default_vocabulary(), ["a", "b", "c"], np.column_stack([langid._smooth(counts[:, k], grid) for k in range(3)]))
    texts = ["\U00010400" * 5000, "\U00010400" * 48, "the" * 4000]
    judged = langid.Scorer(model).judge(texts)
    assert all(0 <= x["score"] <= 1 for x in judged)
    assert np.isclose(judged[0]["score"], judged[1]["score"]) or judged[0]["score"] >= 1 / 3
    likely = langid.log_likelihood(model.prob, grid, texts)
    assert np.isfinite(likely).all()
    assert np.ptp(model.prob[grid.unknown]) == 0
    long = langid.expected_counts(model.prob[:, 1], grid, ["the" * 300, "x"], np.ones(2))
    assert np.isfinite(long).all() and 100 < long.sum() < 1000


def test_language_id(docs, rows, empty):
    learn = F.col("doc_id") % 3 != 1
    out, c = langid.train_and_identify(docs, learn, langid.default_vocabulary())
    got = out.select("doc_id", "text", "lang", f"{c}.lang_pred", f"{c}.score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    held = [r for r in got if r.lang and r.doc_id % 3 == 1 and len(r.text.split()) > 5]
    assert held and all(r.lang == r.lang_pred for r in held)
    nothing, c = langid.train_and_identify(docs, F.lit(False), langid.default_vocabulary())
    assert {tuple(r[c]) for r in nothing.collect()} == {("und", 0.0)}
    assert langid.train_and_identify(empty, learn, langid.default_vocabulary())[0].count() == 0


def test_pipeline_stages(spark, docs, rows, empty, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    at = docs.select(base)
    steps = dict(corpus_pipeline.STAGES)
    named = steps["language ID"](spark, at, str(tmp_path))
    kept = {r.doc_id for r in named.collect()}
    assert named.columns == base and 48 not in kept and {0, 1, 2, 3} <= kept  # 48: no letter
    single = steps["SimHash near-dedup"](spark, named, str(tmp_path))
    classes = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(named).collect()}
    assert {r.doc_id for r in single.collect()} == {a for a, b in classes if a == b} and single.columns == base
    clean = steps["benchmark decontamination"](spark, single, str(tmp_path))
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {50} and clean.columns == base
    mixed = steps["mixing sources to target weights"](spark, clean, str(tmp_path))
    assert mixed.columns == base and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert steps["token-ID output"](spark, mixed, str(tmp_path)).count() == mixed.count()
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty.select(base), str(tmp_path)).count() == 0


def test_pipeline_language_stage_drops_only_letterless_texts(spark):
    """Eight languages with the same words leave each at 1/8; a corpus without labels stays whole."""
    rows = [(i, "same words here", f"l{i % 8}") for i in range(64)] + [(100, "Anna", None), (101, "12 ?", None), (102, None, None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, range(64)), "100", "None"])
    assert corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == len(rows)


def test_pipeline_keeps_one_row_of_each_component(spark):
    rnd = random.Random(13)
    a, b, c, d = (" ".join(rnd.choices([f"{x}{i}" for i in range(99)], k=60)) for x in "abcd")
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, b, "t"), (None, b, "s"), (2, c, "s"), (2, c, "s"), (2, c, "t"), (2, d, "s"), (None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (0, b), (2, c), (2, d), (0, "")])


def test_pipeline_mixes_rows_without_ids_by_their_own_plan(spark):
    docs = spark.createDataFrame([(None, f"x{i} " * n, "en", f"src{i % 2}") for i, n in enumerate((3, 50, 70, 200, 9, 30))] + [(7, "y " * 40, "de", "src0"), (7, "z " * 90, "de", "src1")],
                                 "doc_id long, text string, lang string, source string")
    plan = mixing.plan_mixture(docs.withColumn("d", F.col("text")), corpus_pipeline.domain(), corpus_pipeline.WEIGHTS, keep=("d",)).collect()
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    tokens = {}
    for r in got:
        tokens[r.text.split()[0]] = tokens.get(r.text.split()[0], 0) + len(r.text.split())
    assert tokens == {r.d.split()[0]: r.taken_tokens for r in plan if r.taken_tokens}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert names == list(queries.queries()) and set(queries.oracle_sql()) <= set(names)
