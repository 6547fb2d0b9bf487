import random
import re

from driftline.llm import secret_scan as ss

ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def brute(text):
    out = []
    for m in re.finditer(ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(ss.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_kinds_as_plain_expressions():
    r = random.Random(9)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "APIKEY", "secret", "AKIA", "akia", "=", ":", " ", '"', "'", "é", "ſ", "K",
            "0123456789abcdef", "ABCDEFGHIJKLMNOP", "deadbeef", "x", "_", "\n", "梦", "-", "/"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        got = [f for f in ss.find(text) if f[0] in ss.KINDS[:3]]
        assert got == brute(text), text


def test_checksums_decide():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good = ss.checksum(body.encode()).decode()
    wrong = ("0" if good[0] != "0" else "1") + good[1:]
    assert ("github", 5, 45) in ss.find(f"say: ghp_{body}{good} ok")
    assert ("npm", 0, 40) in ss.find(f"npm_{body}{good}")
    assert not [f for f in ss.find(f"ghp_{body}{wrong}") if f[0] == "github"]


def test_mask_merges_spans():
    text = 'é token = "0123456789abcdef0123" end'
    assert ss.mask(text) == f'é {ss.PLACEHOLDER}" end'
    assert ss.mask(None) is None and ss.mask("plain") == "plain"
    assert not ss.find(ss.mask(text))


def test_odd_rows(odd_documents, no_documents):
    assert ss.report(odd_documents).count() == odd_documents.count()
    assert ss.report(no_documents).count() == 0
    masked = ss.redact(odd_documents)
    assert masked.columns == odd_documents.columns and masked.exceptAll(odd_documents).count() == 0
