"""Spelling variants, secret scans and fill-in-the-middle against brute force, SQL and round trips."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter

import pytest

from larder.llm import fim, secretscan, variants

from ..oracle import SF, same

CLASH = "doc_id long, text string, n long, word string, key string, form string, spans string, letter string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", "k", "f", "s", "l") for i, t in rows], CLASH)


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    out, form = {}, {}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and one_apart(v, w)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def groups(df):
    return {r["word"]: tuple(r)[1:] for r in df.collect()}


def test_variants_query(spark):
    assert same(variants.query(spark, SF), variants.ORACLE) > 1000


def test_words_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "Überall überall ÜBERALL straße Straße STRASSE × ÷ ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (7, None), (8, ""), (9, "don't stopping-place stopping stopping")]
    assert dict(map(tuple, variants.words(clashing(spark, docs)).collect())) == brute_words(docs)


@pytest.mark.parametrize("alphabet", ["ab", "abcéÿ×", "aBÀ"])
def test_variants_of_dense_words(spark, alphabet):
    """Few letters, so that words have many neighbours, runs of equal letters, and ties."""
    rng = random.Random(alphabet)
    n = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))): rng.choice([3, 4, 7, 8, 9, 30, 61, 200]) for _ in range(150)}
    assert groups(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_groups(n)


def test_variants_of_long_words(spark, monkeypatch):
    """Words on both sides of the length beyond which prefixes are hashed."""
    rng = random.Random(5)
    n = {}
    for size in (62, 63, 64, 65, 66, 300):
        base = "".join(rng.choice("abé") for _ in range(size))
        n[base] = 50
        for k in range(6):
            i = rng.randrange(size)
            n[base[:i] + rng.choice(["", "c", base[i] * 2]) + base[i + 1 :]] = rng.choice([3, 20, 50, 120])
    n |= {"a" * k: k for k in range(60, 70)}
    assert groups(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_groups(n)
    began = time.time()
    assert sum(1 for _ in variants.long_entries("ab" * 50_000)) == 200_001
    assert time.time() - began < 30


def test_variants_edges(spark):
    empty = clashing(spark, [])
    assert variants.words(empty).count() == 0
    assert variants.grouped(variants.words(empty)).count() == 0
    rows = [(1, "house house house housed housed housed"), (1, "house house house"), (2, None), (None, "")]
    counted = variants.words(clashing(spark, rows), typo=1 << 40)
    assert groups(variants.grouped(counted)) == {"house": (None, "house", 6, 1, None), "housed": ("house", "house", 3, 1, 6)}


def test_roots_of_a_long_chain(spark):
    n = {"x" * k: 1 << (k + 1) for k in range(1, 41)}
    got = groups(variants.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"x" * 40}


# --- secrets


def der(tag, *held):
    body = b"".join(held)
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def number(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


RNG = random.Random(9)
BIG = [RNG.getrandbits(1024) | 1 << 1023 for _ in range(8)]
RSA = der(0x30, number(0), *map(number, BIG))
CURVE = bytes.fromhex("06082a8648ce3d030107")
EC = der(0x30, number(1), der(4, RNG.randbytes(32)), der(0xA0, CURVE), der(0xA1, der(3, b"\0\4" + RNG.randbytes(64))))
ED = der(0x30, number(0), der(0x30, bytes.fromhex("06032b6570")), der(4, der(4, RNG.randbytes(32))))
PKCS8 = der(0x30, number(0), der(0x30, bytes.fromhex("06092a864886f70d010101"), b"\5\0"), der(4, RSA))
LOCKED = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d01050d"), der(0x30)), der(4, RNG.randbytes(64)))
DSA = der(0x30, number(0), *map(number, BIG[:5]))
PUBLIC = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d010101"), b"\5\0"), der(3, b"\0" + der(0x30, number(BIG[0]), number(65537))))
wire = lambda *xs: b"".join(len(x).to_bytes(4, "big") + x for x in xs)
SSH = b"openssh-key-v1\0" + wire(b"none", b"none", b"") + (1).to_bytes(4, "big") + wire(wire(b"ssh-ed25519", RNG.randbytes(32)), RNG.randbytes(136))
b64 = lambda x: base64.b64encode(x).decode()
url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")


def pem(label, data, gap="\n"):
    body = b64(data)
    return f"-----BEGIN {label}-----{gap}" + gap.join(body[i : i + 64] for i in range(0, len(body), 64)) + f"{gap}-----END {label}-----"


def jwt(alg="HS256", size=32, head=None, claims=b'{"sub":"1","name":"A"}'):
    return ".".join((url(json.dumps({"alg": alg, "typ": "JWT"}).encode() if head is None else head), url(claims), url(RNG.randbytes(size))))


def kinds(text):
    return [k for k, _, _ in secretscan.spans(text) if k not in secretscan.BASE]


@pytest.mark.parametrize("data", [RSA, EC, ED, PKCS8, LOCKED, DSA, SSH])
def test_keys_are_confirmed_and_damaged_ones_are_not(data):
    assert secretscan.private_key(data)
    for text in (b64(data), url(data), data.hex(), data.hex().upper()):
        found = [x for x in secretscan.spans(f"é see {text} there") if x[0] == "key"]
        assert found == [("key", 6, 6 + len(text))]
    assert not secretscan.private_key(data + b"\0") and not secretscan.private_key(data[:-1])
    longer = bytearray(data)
    longer[18 if data is SSH else 3 if data[1] & 0x80 else 1] += 1
    assert not secretscan.private_key(bytes(longer))
    assert kinds(b64(data[:-3])) == kinds(data[:-3].hex()) == []


def test_public_keys_and_noise_are_no_secrets():
    for data in (PUBLIC, der(0x30, number(5)), b"", b"\x30", b"\x30\x80", b"\x30\x84\xff\xff\xff\xff" + bytes(60), der(0x30, *[number(0)] * 9), RNG.randbytes(200)):
        assert not secretscan.private_key(data)
    assert kinds(pem("PRIVATE KEY", PUBLIC)) == kinds("x" * 5000) == kinds("30" * 5000) == kinds("MII" * 5000) == []
    deep = b"\5\0"
    for _ in range(40):
        deep = der(0x30, deep)
    assert not secretscan.private_key(deep)


def test_pem_blocks():
    for label, data in (("RSA PRIVATE KEY", RSA), ("PRIVATE KEY", PKCS8), ("EC PRIVATE KEY", EC), ("OPENSSH PRIVATE KEY", SSH), ("ENCRYPTED PRIVATE KEY", LOCKED)):
        for gap in ("\n", "\r\n", "\\n"):
            block = pem(label, data, gap)
            assert ("pem", 4, 4 + len(block)) in secretscan.spans(f"ab: {block} end")
    block = pem("RSA PRIVATE KEY", RSA)
    assert kinds(block.replace("END RSA", "END EC")) == kinds(block[:300]) == kinds(block.replace("MII", "MIJ", 1)) == []


def test_signed_tokens():
    for alg, size in (("HS256", 32), ("HS512", 64), ("ES256", 64), ("EdDSA", 64), ("RS256", 256)):
        token = jwt(alg, size)
        assert ("jwt", 8, 8 + len(token)) in secretscan.spans(f"Bearer: {token}, and")
    for bad in (jwt("HS256", 33), jwt("none", 32), jwt("RS256", 64), jwt(head=b'{"typ":"JWT-without"}'), jwt(head=b"[1,2,3,4,5,6,7,8]"), jwt(claims=b"[]"), jwt(claims=b"{1}"), jwt(head=b"[" * 5000), jwt(head=b'{"alg":["HS256"]}x')):
        assert kinds(bad) == []


def test_base_patterns_keep_what_a_failed_match_took():
    cases = {
        'token = "abcdef1"': [("assign", 0, 16)], "secret=token:abcdef": [], "SECRET: abcde": [], "Api_Key='abcdef.g=='": [("assign", 0, 19)], "apikey:=abcdef": [("assign", 0, 14)],
        "to\u212aen=abcdef pa\u017fswd=abcdef": [], "AKIA" + "A" * 16: [("access", 0, 20)], "AKIA" + "A" * 15: [], "a" * 24: [("hex", 0, 24)], "A" * 30: [], "a" * 23: [], "password=" + "0" * 24: [("assign", 0, 33), ("hex", 9, 33)],
    }
    assert {t: secretscan.spans(t) for t in cases} == cases


def plain_base(text):
    low, out = text, []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", low):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", low) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", low) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets_query(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_001, f"key: {b64(RSA)} AKIA{'B' * 20}\npassword = {'0af' * 9}"), (10_002, pem("PRIVATE KEY", ED)), (10_003, None), (10_004, ""), (10_005, f"secret: {jwt()}"), (10_005, f"secret: {jwt()}"), (None, "token=abcdefg"), (10_006, "ab " * 300_000 + EC.hex())]
    clashing(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secretscan.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in docs:
        base = plain_base(text or "")
        every = [f"{k}:{a}:{b}" for k, a, b in secretscan.spans(text)]
        assert [x for x in every if x.split(":")[0] in secretscan.BASE] == base
        want.append((i, *[sum(x.startswith(k) for x in base) for k in secretscan.BASE], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(every)))
    assert got == sorted(want, key=str)
    assert sum("key:" in r[5] for r in got) == 3 and sum("pem:" in r[5] for r in got) == 1 and sum("jwt:" in r[5] for r in got) == 2
    assert secretscan.scanned(clashing(spark, [])).count() == 0


# --- fill in the middle


def test_fim_query(spark):
    assert same(fim.query(spark, SF), fim.ORACLE) == 200


def test_units_by_repeated_captures():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab é\n\t  \x1f\x0b") for _ in range(rng.randint(0, 30)))
        want = [m.end() for m in re.finditer("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+", text)]
        assert fim.ends(text) == want
    began = time.time()
    assert len(fim.ends("word  " * 500_000)) == 500_001 and len(fim.ends(" " * 3_000_000)) == 1
    assert time.time() - began < 20


def test_fim_round_trip_and_edges(spark):
    tricky = ["", None, " ", "a", "a <P> b", "<S>", "x <M", "ends with < and <P", "P> S> M> <", "é " * 400, "one two three four five", "\n\n", "tail   "]
    rows = [(i, tricky[i % len(tricky)]) for i in range(520)] + [(-5, "negative id here now"), (None, "no id at all here"), (3, "again"), (3, "again")]
    made = fim.transformed(clashing(spark, rows)).withColumn("back", fim.restored("output", "form"))
    got = sorted(((r["doc_id"], r["back"], r["form"]) for r in made.collect()), key=str)
    assert [(i, t) for i, t, _ in got] == sorted(((i, t or "") for i, t in rows), key=str)
    forms = Counter(f for _, t, f in got if t and not any(m in t for m in ("<P>", "<S>", "<M>")))
    assert {f for _, t, f in got if not t or any(m in t for m in ("<P>", "<S>", "<M>"))} == {"plain"}
    assert forms["plain"] > forms["spm"] > forms["psm"] > 10
    for r in made.where("form <> 'plain'").collect():
        head = "<P>" if r["form"] == "psm" else "<S>"
        assert r["output"].startswith(head) and r["prefix_chars"] + r["middle_chars"] <= len(r["back"])
        at = r["output"].index("<M>") + 3
        assert len(r["output"]) - at == r["middle_chars"]
    assert fim.transformed(clashing(spark, [])).count() == 0
    every = fim.transformed(clashing(spark, [(i, "a b c") for i in range(300)]), rate=100, spm=0)
    assert {r["form"] for r in every.select("form").distinct().collect()} == {"psm"}
