"""Secret scans: base patterns against plain regular expressions, layers against planted secrets."""

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import random
import re
import tarfile
import urllib.parse
import zlib

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import queries, secret_scan

from .conftest import SMALL

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRET = 'token = "s3cr3t-value-42"'


def base(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def b64(data):
    return base64.b64encode(data).decode()


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIkey", "toKen", "ſecret", '"', "'", " ", ":", "=", "abc", "12345678", "AKIA", "ABCDEFGH",
            "0123456789abcdef" * 2, "deadbeef", "g", "\n", "é", "x.y/z+w", "-", "A"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secret_scan.scan(text)[0] == base(text), text
        assert set(base(text)) <= set(secret_scan.scan(text)[1])


def test_layers_map_to_the_text():
    wraps = {
        "base64": b64(SECRET.encode()), "twice": b64(b64(SECRET.encode()).encode()), "gzip": b64(gzip.compress(SECRET.encode())),
        "zlib": b64(zlib.compress(SECRET.encode())), "bz2": b64(bz2.compress(SECRET.encode())), "xz": b64(lzma.compress(SECRET.encode())),
        "zstd": b64(zstandard.compress(SECRET.encode())), "gzip twice": b64(gzip.compress(gzip.compress(SECRET.encode()))),
        "url-safe": base64.urlsafe_b64encode(("ÿþ>>>??? " + SECRET).encode()).decode().rstrip("="),
        "mixed": urllib.parse.quote(b64(gzip.compress(b64(SECRET.encode()).encode())), safe=""),
    }
    for name, token in wraps.items():
        text = f"see {token} here"
        found = secret_scan.scan(text)[1]
        assert found, name
        assert all(4 <= a < b <= 4 + len(token) for _, a, b in found), (name, found)
    percent = "q=" + "".join(f"%{b:02X}" for b in SECRET.encode()) + "&x"
    assert secret_scan.scan(percent)[1] == [("assign", 2, 2 + 3 * (len(SECRET) - 1))]
    escaped = "".join(f"\\u{ord(c):04x}" for c in SECRET)
    assert secret_scan.scan(f"s: {escaped}")[1] == [("assign", 3, 3 + 6 * (len(SECRET) - 1))]
    entities = SECRET.replace('"', "&quot;").replace("=", "&#61;")
    assert [(k, entities[a:b]) for k, a, b in secret_scan.scan(entities)[1]] == [("assign", entities[:-6])]
    inside = f"x {b64(('padding words here ' + SECRET).encode())} y"
    (kind, a, b), = secret_scan.scan(inside)[1]
    assert kind == "assign" and "token" in base64.b64decode(inside[2 + (a - 2) // 4 * 4:2 + -(-(b - 2) // 4) * 4]).decode()


def test_binary_layers():
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        info = tarfile.TarInfo(".env")
        info.size = 23
        tar.addfile(info, io.BytesIO(b"password=hunter2hunter2"))
    tar, key = raw.getvalue(), "AKIA" + "ABCDEFGH12345678"
    layers = {
        "tar": tar, "tar.gz": gzip.compress(tar), "utf-16": SECRET.encode("utf-16"), "utf-16-le": SECRET.encode("utf-16-le"),
        "utf-16-be": SECRET.encode("utf-16-be"), "utf-16 in binary": b"\xff\x01\x02" + SECRET.encode("utf-16-le") + b"\x00\x00\xfe",
        "latin-1": f"Zugangsschlüssel für Ärzte: {SECRET}".encode("latin-1"), "late": b"\x01" * 4096 + SECRET.encode(),
        "binary": random.Random(2).randbytes(500) + b" " + key.encode() + b" \xff",
    }
    for name, data in layers.items():
        text = f"see {b64(data)} here"
        found = [s for s in secret_scan.scan(text)[1] if s[0] in ("assign", "access")]
        assert len(found) == 1 and 4 <= found[0][1] < found[0][2] <= len(text) - 5, (name, found)
    (_, a, b), = secret_scan.scan(b64(b"\xff\xfe\xfd" + SECRET.encode("utf-16-le")))[1]
    last = 3 + 2 * (len(SECRET) - 2)  # byte of the last character found
    assert (a, b) == (4, 4 * (last // 3) + last % 3 + 2)


def test_tokens_after_words_and_over_lines():
    secret = "password=hunter2hunter2"
    packed = b64(gzip.compress((secret + " " + random.Random(4).randbytes(200).hex(" ")).encode()))
    for token in (b64(secret.encode()), packed, b64(b64(secret.encode()).encode())):
        for before in ("https://x.io/cb/", "id_", "see data/", "a-", "ab-", "abc-", "/", "x_y_z/"):
            text = f"{before}{token}"
            assert [(k, a >= len(before), b <= len(text)) for k, a, b in secret_scan.scan(text)[1] if k == "assign"] == [("assign", True, True)], text
    body = "\n".join(["first line of a message", *["and some more words"] * 9, secret, "the end"])
    for data in (body.encode(), gzip.compress((secret + random.Random(5).randbytes(300).hex(" ")).encode())):
        for width in (20, 64, 76):
            for mark in ("\n", "\r\n", "\n  "):
                lines = mark.join(b64(data)[i:i + width] for i in range(0, len(b64(data)), width))
                for before in ("", "body: ", "body:\n", "body\n"):
                    text = f"{before}{lines}\n"
                    found = {s for s in secret_scan.scan(text)[1] if s[0] == "assign"}
                    assert found and all(len(before) <= a < b <= len(text) - 1 for _, a, b in found), (width, mark, before)


def test_members_frames_and_written_bytes():
    secret = b" password=hunter2hunter2 "
    # A secret that the packing left as it was is found in the packed bytes as well.
    wide = lambda text: max((s for s in secret_scan.scan(text)[1] if s[0] == "assign"), key=lambda s: s[2] - s[1], default=None)
    skippable = b"\x50\x2a\x4d\x18\x04\x00\x00\x00abcd"
    for name, pack, gap in (("gzip", gzip.compress, b""), ("zlib", zlib.compress, b""), ("bz2", bz2.compress, b""), ("xz", lzma.compress, b"\0" * 4),
                            ("zstd", zstandard.compress, b""), ("zstd", zstandard.compress, skippable)):
        token = b64(pack(b"clean text here") + gap + pack(b"more of it, pass") + gap + pack(secret[1:]))
        assert wide(f"x {token} y") == ("assign", 2, 2 + len(token)), name
        token = b64(pack(b"clean text here, pass") + pack(b"word=hunter2hunter2"))  # over the border of two members
        assert wide(f"x {token} y") == ("assign", 2, 2 + len(token)), name
        data = pack(secret * 3)
        percent, escapes = urllib.parse.quote(data, safe=""), "".join(f"\\x{b:02x}" for b in data)
        for text in (percent, escapes, "".join(f"%{b:02X}" for b in data), "".join(f"\\u{b:04x}" for b in data), "".join(f"&#{b};" for b in data), repr(data)[2:-1]):
            assert wide(f"q= {text} !") == ("assign", 3, 3 + len(text)), (name, text)
    inner = gzip.compress(b"0 " * 50_000 + secret)
    assert wide(b64(b"some bytes first \xff" + lzma.compress(b"\0" * 100 + inner)))


def test_oversized_content_is_scanned():
    rng = random.Random(6)
    words = " ".join(rng.choice(("some", "words", "of", "text.")) for _ in range(60_000)).encode()
    secret = b" password=hunter2hunter2 "
    for limit in (10_000, 65_536, 1 << 20):
        for at in (0, limit - 12, limit + 5, 2 * limit - 10, len(words)):
            for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
                token = b64(pack(words[:at] + secret + words[at:]))
                big = len(words) + len(secret) > limit
                want = [("assign", 2, 2 + len(token))] + [("oversize", 2, 2 + len(token))] * big
                found = set(secret_scan.scan(f"x {token} y", limit=limit)[1])
                assert found >= set(want) and {s[0] for s in found} == {s[0] for s in want}, (limit, at, pack)
    for hidden in (b64(secret * 40).encode(), gzip.compress(rng.randbytes(5000) + secret)):  # open at the border of two windows
        token = b64(gzip.compress(words[:7_000] + b" ." + hidden + b" " + words))
        assert [s[0] for s in secret_scan.scan(token, limit=10_000)[1]] == ["assign", "oversize"]


def test_plain_texts_gain_nothing():
    for text in ("100% of %%% and &amp; so on", "the thing of words" * 50, b64(random.Random(1).randbytes(60)), "a" * 40_000, "%41" * 1000):
        assert secret_scan.scan(text)[1] == secret_scan.scan(text)[0] == base(text)


def test_cycles_depth_and_bombs():
    text = SECRET
    for _ in range(12):
        text = b64(text.encode())
    assert [s[0] for s in secret_scan.scan(text)[1]] == ["assign"] and secret_scan.scan(text)[2] == 13
    bomb = b64(gzip.compress(b"0" * 5_000_000))
    base_found, found, _ = secret_scan.scan(f"x {bomb}", limit=1_000_000)
    assert base_found == [] and found == [("oversize", 2, 2 + len(bomb))]
    both = "%2541" * 50 + "\\u0025" * 50  # two kinds of decoding, in either order
    assert secret_scan.scan(both)[2] < 20


def test_query_matches_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op10_secrets"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumns({"spans": F.lit(1), "ID": F.lit(2), "layers": F.lit("b")})
    got = secret_scan.find_secrets(clash).collect()
    assert len(got) == 11 and all(r["spans"] == [] for r in got)
    assert secret_scan.find_secrets(no_docs).collect() == []


def test_inflated_repetition_is_scanned_once():
    import base64
    import bz2
    import gzip
    import time
    zeros = bytes(100 << 20)
    began = time.perf_counter()
    bomb = base64.b64encode(bz2.compress(zeros)).decode()
    assert secret_scan.scan("x " + bomb)[1] == [("oversize", 2, 2 + len(bomb))]
    token = base64.b64encode(gzip.compress(zeros[:40 << 20] + b" password=hunter2hunter2 " + zeros[:40 << 20])).decode()
    assert secret_scan.scan(token)[1] == [("assign", 0, len(token)), ("oversize", 0, len(token))]
    assert time.perf_counter() - began < 20
    small = base64.b64encode(gzip.compress(b"a" * 20_000 + b" " + b"0123456789abcdef" * 2)).decode()
    assert {k for k, _, _ in secret_scan.scan(small)[1]} == {"hex"}
    assert secret_scan._collapsed(b"ab" + b"c" * 9000 + b"d") == b"ab" + b"c" * secret_scan.RUN + b"d"
    assert secret_scan._collapsed(b"xy" * 9000) == b"xy" * 9000
