import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
from urllib.parse import quote

import zstandard
from pyspark.sql import functions as F

from papyra.llm.secrets_scan import KINDS, base_spans, find_secrets, redact, redact_secrets, scan

KEY = "AKIA" + "ABCDEFGH12345678"


def slow(text):
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    word = "|".join(map(letters, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY]"
    rows = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    rows += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    rows += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(rows)


def test_base_against_slow():
    rnd = random.Random(0)
    parts = ["token", "TOKEN", "secret", "ſecret", "toKen", "api_key", "APIkey", "=", ":", " ", '"', "'", "abc", "abcdef", "0" * 23, "AKIA", "B" * 15, "é", "\n", KEY]
    for _ in range(20000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert base_spans(t) == slow(t), t


def found(text):
    return {(KINDS[k], s, e) for s, k, e in scan(text)[1]}


def test_layers_map_to_the_document():
    b64 = lambda b: base64.b64encode(b).decode()
    assert ("access", 4, 4 + 60) in found("é - " + "".join(f"%{ord(c):02X}" for c in KEY) + " end")
    assert ("access", 2, 2 + 120) in found("x " + "".join(f"\\u{ord(c):04x}" for c in KEY))
    assert ("access", 0, 120) in found("".join(f"&#{ord(c)};" if ord(c) > 99 else f"&#0{ord(c)};" for c in KEY))
    plain = b64(b"my token = abcdef123456 it is")
    assert ("assign", 5 + 4, 5 + 32) in found("data " + plain)
    assert ("access", 3, 3 + len(b64(KEY.encode()))) in found("^^ " + b64(KEY.encode()) + " $")
    for pack in (gzip.compress, zstandard.compress, lambda b: gzip.compress(zstandard.compress(b))):
        z = b64(pack(f"secret: {KEY} é".encode()))
        assert {("access", 1, 1 + len(z)), ("assign", 1, 1 + len(z))} <= found("(" + z + ")")
    nested = quote(b64(quote(b64(f"password: {KEY}".encode()), safe="").encode()), safe="")
    assert {"access", "assign"} <= {k for k, _, _ in found("see " + nested)}
    twice = b64(KEY.encode())
    assert {s for k, s, _ in found(f"{twice} and {twice}")} == {0, len(twice) + 5}


def test_ends():
    assert scan("") == ([], [], 0, True)
    assert scan("%25%2525 \\u005cu005c &#38;#38;")[3]
    bomb = base64.b64encode(gzip.compress(b"a" * 50_000_000)).decode()
    assert scan(bomb, most_decoded=10**6)[3] is False
    assert scan("word " * 50_000 + KEY)[0] == [(250_000, 1, 250_020)]
    assert redact(f"a {KEY} token={'0' * 30} b") == "a [access] [assign] b"
    assert redact("nothing") == "nothing"


def test_odd_rows(spark, odd_docs, no_docs):
    assert find_secrets(no_docs).count() == 0
    more = spark.createDataFrame([(20, f"é{KEY}", None, None, None)], odd_docs.schema)
    docs = odd_docs.union(more)
    got = find_secrets(docs.withColumns({c: F.lit(1) for c in ("spans", "n_hex", "complete")})).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(str((r.doc_id, *(sum(x[1] == k for x in slow(r.text or "")) for k in range(3)), sha(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in slow(r.text or ""))))) for r in docs.collect())
    assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert [r.spans for r in got if r.doc_id == 20] == ["access:1:21"]
    clean = {(r.doc_id, r.text, r.n_chars) for r in redact_secrets(docs, length_col="n_chars").collect()}
    assert (20, "é[access]", 9) in clean
    assert clean - {(20, "é[access]", 9)} == {(r.doc_id, r.text, r.n_chars) for r in odd_docs.collect()}
    assert redact_secrets(no_docs).count() == 0


def test_large_layers_are_scanned_whole():
    b64 = lambda b: base64.b64encode(b).decode()
    filler = "some words, and é more. " * 400_000
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress, lambda b: gzip.compress(zstandard.compress(b))):
        z = b64(pack(f"{filler}{KEY} end".encode()))
        assert scan(f"({z})")[1:] == ([(1, 1, 1 + len(z))], 1, True)
        assert redact(f"({z})") == "([access])"
    half = b64(gzip.compress(("words, " * 200_000).encode() + b64(f"x {KEY} y".encode()).encode()))
    assert [k for _, k, _ in scan(half)[1]] == [1]
    text = "word " * 3_400_000 + "%41" + KEY[1:]
    assert (17_000_000, 1, 17_000_000 + 22) in scan(text)[1]


def test_wrapped_odd_and_several_members():
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n, nl="\n": nl.join(t[i : i + n] for i in range(0, len(t), n))
    for width, nl in ((64, "\n"), (76, "\r\n")):
        t = wrap(b64(b"x" * 40 + b" " + KEY.encode() + b" " + b"y" * 99), width, nl)
        pem = f"-----BEGIN CERTIFICATE-----{nl}{t}{nl}-----END"
        (span,) = {(s, e) for k, s, e in found(pem) if k == "access"}
        assert span[0] > 27 and nl in pem[slice(*span)] and KEY not in redact(pem)
        packed = wrap(b64(gzip.compress(random.Random(1).randbytes(500) + f" {KEY} ".encode())), width, nl)
        assert "access" in {k for k, _, _ in found(f"see: {packed}.")}
    for odd in ("\u00a0", "\ufeff", "\u00ad", "\u2028", "\0", "\x1b"):
        assert "access" in {k for k, _, _ in found(b64(f"cle{odd}: {KEY}".encode()))}
    assert "access" in {k for k, _, _ in found(b64(b"\xff\xfe " + KEY.encode()))}
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        assert "access" in {k for k, _, _ in found(b64(pack(b"first member, ") + pack(f" {KEY}".encode())))}


def test_what_hides_a_layer():
    b64 = lambda b: base64.b64encode(b).decode()
    kinds = lambda t: {k for k, _, _ in found(t)}
    assert "access" in kinds("see path/x/" + b64(f"the key {KEY}".encode()))
    assert "access" in kinds("path/to/" + b64(gzip.compress(f"the key {KEY}".encode())))
    for coding in ("utf-16", "utf-16-le", "utf-16-be"):
        assert "access" in kinds(b64(f"clé: {KEY}".encode(coding))) and "access" in kinds(b64(gzip.compress(f"clé: {KEY}".encode(coding))))
    for odd in ("\x0b", "\u200b", "\x01"):
        assert "access" in kinds(b64(f"a{odd}b {KEY}{odd}".encode()))
    data = f"deep {KEY}".encode()
    for _ in range(70):
        data = gzip.compress(data)
    assert kinds(b64(data)) == {"access"} and scan(b64(data))[3]
    text = f"deep {KEY}"
    for _ in range(12):
        text = b64(text.encode())
    assert kinds(text) == {"access"}
    z = b64(gzip.compress(b"\x78\x9c no form at all " + KEY.encode()))
    assert kinds(z) == {"access"}


def test_random_nestings():
    """A key behind random layers is found, and its span covers no more than the layers and reaches the last coded character that matters."""
    rnd = random.Random(7)
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n: "\n".join(t[i : i + n] for i in range(0, len(t), n))
    layers = [
        lambda t: b64(t.encode()), lambda t: b64(t.encode()).rstrip("="), lambda t: base64.urlsafe_b64encode(t.encode()).decode(), lambda t: wrap(b64(t.encode()), 76), lambda t: wrap(b64(t.encode()), 64),
        lambda t: b64(gzip.compress(t.encode())), lambda t: b64(bz2.compress(t.encode())), lambda t: b64(lzma.compress(t.encode())), lambda t: b64(zstandard.compress(t.encode())), lambda t: wrap(b64(gzip.compress(t.encode())), 76),
        lambda t: quote(t, safe=""), lambda t: "".join(f"%{b:02x}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(f"&#x{ord(c):X};" for c in t),
    ]
    ends = ["", " ", "some words before ", "é: ", "(", "x = ", "line\n"]
    for _ in range(300):
        text = f"{rnd.choice(ends)}{KEY}{rnd.choice([' ', ';', chr(10) + 'end'])}"
        for _ in range(rnd.randrange(1, 4)):
            text = rnd.choice(layers)(text)
        before = rnd.choice(ends)
        doc = before + text + rnd.choice(["", " ", "; more", " end."])
        spans = {(s, e) for k, s, e in found(doc) if k == "access"}
        assert any(len(before) <= s < e <= len(before) + len(text) for s, e in spans), doc
        assert scan(doc)[3]
        assert KEY not in redact(doc) and not any(k == "access" for k, _, _ in found(redact(doc))), doc
