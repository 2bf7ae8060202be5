"""Base spans against the plain patterns; literals against written-out cases."""

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidefeed.llm import queries, secret_scan as S
from tidefeed.llm.assignments import assignments

SF = "/root/testdata/sf0.01"
LETTERS = "(password|passwd|secret|token|api_?key)"
EITHER_CASE = re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", LETTERS)
PLAIN = (("assign", EITHER_CASE + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
         ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))


def plain(text):
    found = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PLAIN)
             for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def literals(text):
    return [text[s["start"]:s["end"]] for s in S.spans_of(text) if s["kind"] == "literal"]


PIECES = ["password", "PassWd", "secret", "api_key", "APIKEY", "token", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "0f" * 9, "abcdef12",
          "x", "\n", "ſecret", "toKen", "é", "==", "zzzzzzzz", "+", ","]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    spans = [f"{s['kind']}:{s['start']}:{s['end']}" for s in S.spans_of(text)]
    assert [s for s in spans if not s.startswith("literal")] == plain(text)
    places = [(s["start"], S.KINDS.index(s["kind"])) for s in S.spans_of(text)]
    assert places == sorted(places)


def test_query_meets_the_contract(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())
    assert sum(r.n_assign for r in rows) >= 12


def test_sources_and_configurations():
    value = "pX9!kQ2#vT7z"
    for text in (f"db_pwd = '{value}'", f'{{"passphrase": "{value}", "n": 1}}', f"privateKey: {value.replace('#', '-')}\n", f"$dbPass = \"{value}\";",
                 f"conn.credentials := `{value}`", f":credential => '{value}'", f"<passphrase>{value}</passphrase>",
                 f"define('DB_PWD', '{value}');", f"cfg['signing_key'] = \"{value}\"", f"String encryptionKey = \"{value}\";"):
        assert [x.replace("-", "#") for x in literals(text)] == [value], text


def test_constants_are_followed():
    value = "pX9!kQ2#vT7z"
    assert literals(f"x = '{value}'\ny = x\nother = 3\ndb_pwd = y\n") == [value]
    assert literals(f"x = '{value}'\nx = 'other'\ndb_pwd = x\n") == []
    assert literals(f"db_pwd = x\nx = '{value}'\n") == []
    assert literals("a = 'pX9!kQ'\ndb_pwd = 'Zr4$' + 'mW8%yL'\n") == ["Zr4$", "mW8%yL"]
    assert literals(f"base = '{value}'\nuser_pwd = base + 'Q7w'\nlog = base") == [value]


def test_clean_texts_are_left_alone():
    for text in ("Note: the pass over the mountain is key to the author.", "pwd_file = '/etc/app/p4sswords9'", "db_pwd = os.getenv('DB_PWD_MAIN1')",
                 "db_pwd = 'changeme123'", "pwd: ${DB_PWD_2024}", "if pwd == 'pX9!kQ2#vT7z': pass", "credential: <your-credential-1>",
                 "token_type = 'bearer-2048-x'", "std::passphrase::value9", "see https://host/keyring9", "key: value"):
        assert literals(text) == [], text


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 z é AKIAABCDEFGHIJKL"), (2, None), (3, "none")], "doc_id long, text string")
    got = docs.select("doc_id", S.redacted(docs.text, S.secrets_column(docs.text)).alias("t")).collect()
    assert [r.t for r in got] == ["a [secret] z é [secret]", None, "none"]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "secret: abcdefgh"), (3, "x" * 200_000 + " db_pwd='pX9!kQ2#vT7z'"), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, found int")
    got = S.digests(S.find_secrets(docs)).orderBy("doc_id", "spans").collect()
    assert [(r.doc_id, r.spans) for r in got] == [
        (None, "assign:0:16"), (1, ""), (2, ""), (3, ""), (3, ""), (3, "literal:200009:200021")]
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert S.digests(S.find_secrets(docs.where("false"))).collect() == []


def test_long_texts_take_linear_time():
    random.seed(3)
    for piece in ("a=", "a:", "a='", "a=\"b", "key=x+", "(((", "<key>", "a = b\n", "a = a + a\n", "pwd = pwd + 'x' \n", "password ", "\\'", "`a=`", "f", "AKI", "a.-$",
                  "key  =  ", "('a', ", "x == ", "' ' ' "):
        text = "pwd " + piece * (400_000 // len(piece))
        begun = time.process_time()
        S.spans_of(text)
        assert time.process_time() - begun < 12, piece
    many = "".join(f"v{i} = v{i - 1} + 'k'\n" for i in range(20_000)) + "db_pwd = v19999\n"
    assert len(assignments(many)) == 20_001
    S.spans_of(many)
