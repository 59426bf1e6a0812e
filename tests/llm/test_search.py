import numpy as np
import pytest

from tablewright.llm import neighbours, secret_scan, url_filter
from tests.llm.brute import sha


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)).astype("f4")
    x[100:160] = x[3]
    x[300] = 0
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows[301] = (301, None, 0)
    rows[302] = (302, [1.0, None] + [0.0] * 14, 0)
    rows[303] = (303, [float("nan")] + [1.0] * 15, 0)
    rows[350] = (350, [float("inf")] + [1.0] * 15, 0)
    rows += [(1000 + i, [1.0, float(i)], 0) for i in range(3)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_neighbours_equal_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    rows, table = vectors
    fine = {
        i: np.array(v, float)
        for i, v, _ in rows
        if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    }
    found = {}
    for r in neighbours.nearest(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in fine if i % 50 == 0}
    for i, listed in found.items():
        q = fine[i]
        best = sorted(
            (-round(float(q @ v / np.sqrt((q @ q) * (v @ v))), 12), j)
            for j, v in fine.items()
            if j != i and len(v) == len(q)
        )[:5]
        assert [x[1] for x in sorted(listed)] == [j for _, j in best]
        assert np.allclose([x[2] for x in sorted(listed)], [-s for s, _ in best], atol=1e-11)


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(200, 32)), rng.normal(size=(200, 32)) ** 3
    (q, qs, qn, qe), (c, cs, cn, ce) = neighbours.quantised(a), neighbours.quantised(b)
    rough = (q.astype(int) * c.astype(int)).sum(axis=1) * qs * cs
    bound = qn * ce + qe * cn + qe * ce
    assert (np.abs(rough - neighbours.cosines(a, b)) <= bound + 1e-12).all() and bound.max() < 0.1


def test_rows_without_ids_large_ids_and_repeated_rows(spark):
    big = (1 << 60) + 1
    rows = [(big - big % 50, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [1.0, 0.1]), (big, [1.0, 0.1]), (7, [0.0, 1.0]), (7, [0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, rank int, score string, size int")
    found = neighbours.nearest(table).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(big - big % 50, x) for x in (big, None, None, 7, 7)]


def test_no_vectors(vectors):
    assert neighbours.nearest(vectors[1].limit(0)).count() == 0


URLS = [
    ("https://www.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("http://a.org", "a.org", "", None, None),
    ("http://borg/x", "borg", "/x", None, None),
    ("https://m.x.com/fr/1", "m.x.com", "/fr/1", "com/fr/", "allow"),
    ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("https://x.com/DE/1", "x.com", "/DE/1", None, None),
    ("x.com/de/1", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("a://b?c://d/e", "b", "", None, None),
    ("a://ÉB.org/p#q?r", "Éb.org", "/p", "org/", "allow"),
    ("http://h.net/" + "a" * 5000, "h.net", "/" + "a" * 5000, None, None),
]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in url_filter.judge(pages).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_model_generalises(spark):
    urls = [(i, f"http://{'spam' if i % 2 else 'news'}{i}.net/{'casino' if i % 2 else 'daily'}/{i}") for i in range(200)]
    labelled = spark.createDataFrame(
        [(u[1][7:].split("/", 1)[0], "/" + u[1][7:].split("/", 1)[1], "block" if u[0] % 2 else "allow") for u in urls[:100]],
        "host string, path string, verdict string",
    )
    pages = spark.createDataFrame(urls[100:], "page_id long, url string")
    found = url_filter.judge(pages, labelled, rules=())
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in found.collect())
    assert {r.verdict for r in url_filter.judge(pages, labelled.limit(0), rules=()).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judge(pages, labelled.where("verdict = 'block'"), rules=()).collect()} == {"block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | ((size.bit_length() + 7) // 8)]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def number(n):
    raw = n.to_bytes(n.bit_length() // 8 + 1, "big")
    return der(2, raw)


RSA = der(0x30, number(0) + b"".join(number(3**k + 2**200) for k in range(60, 300, 30)))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))


def b64(data, plain=True):
    import base64

    return (base64.b64encode if plain else base64.urlsafe_b64encode)(data).decode().rstrip("=" if not plain else "")


TOKEN = ".".join(b64(x, False) for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"12"}', bytes(range(32))))


def kinds(text):
    return [s[0] for s in secret_scan.in_order(secret_scan.base_spans(text) + secret_scan.confirmed_spans(text))]


def test_structures_are_confirmed():
    assert kinds(f"x {b64(RSA)} y") == ["der"] == kinds(f"x {b64(PKCS8)} y")
    assert "der" in kinds(f"x {RSA.hex().upper()} y")
    assert kinds("ssh " + b64(SSH)) == ["ssh"]
    assert kinds(f"a {TOKEN} b") == ["jwt"]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)}\n-----END RSA PRIVATE KEY-----")[-2:] == ["pem", "der"]
    for broken in (RSA[:-1], RSA + b"\0", b"\x30\x83\x00" + RSA[2:], bytes(range(200))):
        assert kinds(f"x {b64(broken)} y") == []
    assert kinds("a eyJhbGciOjF9.eyJhIjoxfQ.AAAA b") == []


BASE = [
    ("", []),
    ("nothing here: at all", []),
    ('Token = "abcdef12" x', ["assign:0:17"]),
    ("password=short", []),
    ("password=shor", []),
    ("my API_KEY: 'a1b2c3' apikey=zzzzzz", ["assign:3:19", "assign:21:34"]),
    ("ſecret=abcdefgh", []),
    ("secret=abc secret=abcdef", ["assign:11:24"]),
    ("token=token=abcdef", ["assign:0:18"]),
    ("AKIA" + "A" * 16 + " AKIA" + "B" * 15, ["access:0:20"]),
    ("é " + "0123456789abcdef" * 2, ["hex:2:34"]),
    ("F" + "a" * 24 + "G" + "b" * 23, ["hex:1:25"]),
    ("secret:" + "a" * 30, ["assign:0:37", "hex:7:37"]),
]


def plain_base(text):
    import re

    found = []
    assign = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [("assign", *m.span()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans_and_table(spark):
    texts = [t for t, _ in BASE if not t.startswith("password=shor")] + ["password=shor", None, "z" * 100_000 + TOKEN]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secret_scan.digests(secret_scan.find_secrets(rows)).collect()}
    expected = {t: s for t, s in BASE}
    for i, text in enumerate(texts):
        base = plain_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[i].base_sha256 == sha(listed)
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        if expected.get(text) and text != "password=short":
            assert listed == ",".join(expected[text])
        assert listed == ",".join(x for x in found[i].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
    assert secret_scan.find_secrets(rows.limit(0)).count() == 0


def test_masking():
    assert secret_scan.mask(None) is None and secret_scan.mask("clean text") == "clean text"
    assert secret_scan.mask('a token = "abcdef12" b') == 'a [SECRET]" b'
    assert secret_scan.mask("x secret:" + "a" * 30 + " y") == "x [SECRET] y"
