import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import Row

from kindred.llm import decontaminate, queries, repetition, secrets

from .conftest import SF, edge_texts, rows_of, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(text, least, width=3):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    lengths = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                lengths[i] = max(lengths[i], k)
    within = lambda f: {p for i, x in enumerate(lengths) for p in range(i, i + f(x))}
    cover = lambda f: len(within(f))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": cover(lambda x: 3 if x >= 3 else 0), "covered_words": cover(lambda x: x if x >= least else 0), "covered_chars": sum(len(w[p]) for p in within(lambda x: x if x >= least else 0)), "longest_repeat": max(lengths, default=0),
    }


def test_repeats_by_brute_force(spark, documents, texts, edge, empty):
    found = {r.doc_id: r for r in queries.op10_repetition(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        if t is None or len(t) < 2500:
            for k, v in brute_repeats(t, 10).items():
                assert found[i][k] == v, (i, k)
        r = found[i]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.covered_chars <= 0.1 * r.word_chars and r.longest_repeat <= 50)
    rows = [(i, t) for i, t in edge_texts() if t is None or len(t) < 5000]
    got = Counter((r.doc_id, r.n_words, r.longest_repeat, r.covered_words) for r in repetition.repetition(edge).collect())
    for i, t in rows:
        b = brute_repeats(t, 10)
        assert got[(i, b["n_words"], b["longest_repeat"], b["covered_words"])] > 0
    kept = repetition.drop_repetitive(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in repetition.repetition(edge).where("kept").collect()}
    assert repetition.repetition(empty).collect() == [] and repetition.drop_repetitive(empty).collect() == []


def test_the_method_rejects_what_the_base_keeps(spark):
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, passage = words(12), words(51)
    texts = {
        "fresh": words(100), "a line of twelve, twice": [*words(60), *line, *words(50), *line], "the same in a long text": [*words(600), *line, *words(50), *line],
        "a passage of 51, twice": [*passage, *words(5000), *passage], "a passage of 50, twice": [*passage[:50], *words(5000), *passage[:50]], "most of it twice": [*words(10), *passage, *passage],
    }
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts.values())], "doc_id long, text string")
    found = {list(texts)[r.doc_id]: (r.base_failed, r.kept) for r in repetition.repetition(docs).collect()}
    assert found == {"fresh": (False, True), "a line of twelve, twice": (False, False), "the same in a long text": (False, True), "a passage of 51, twice": (False, False), "a passage of 50, twice": (False, True), "most of it twice": (True, False)}


def brute_secrets(text):
    text, spans = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans += [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_secrets(spark, texts, edge, empty):
    rows = list(texts.items())
    for found, some in ((queries.op5_secret_scan(spark, SF), rows), (secrets.find_secrets(edge), edge_texts())):
        got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found.collect())
        want = Counter()
        for i, t in some:
            s = brute_secrets(t)
            n = Counter(k for k, _, _ in s)
            want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
        assert got == want
    assert secrets.find_secrets(empty).collect() == []


@pytest.mark.parametrize("text, literals", [
    ('db_password = "s3cr3t!Value9"', ["s3cr3t!Value9"]),
    ('key = "Zx81kPq0Lm"\napi_key = key', ["Zx81kPq0Lm"]),
    ('a = "Zx81kPq0Lm"\nb = a\nauthToken: b', ["Zx81kPq0Lm"]),
    ('{"clientSecret": "Yt6" + "7hGw2pQ"}', ['Yt6" + "7hGw2pQ']),
    ("export AWS_SECRET_KEY=abcDEF123/xyz+4567", ["abcDEF123/xyz+4567"]),
    ('password = "changeme"\nsecret = "${VAULT}"\ncolour = "Zx81kPq0Lm"', []),
    ("token: see https://x.example/y", []),
])
def test_lexing(text, literals):
    assert [text[a:b] for _, a, b in secrets.lexed_spans(text, 0.5)] == literals


@pytest.mark.parametrize("text, literals", [
    ('api_key: str = "sk-Live9Qx72LmPz0aR"', ["sk-Live9Qx72LmPz0aR"]),
    ('db_pwd: str = "Zx81kPq0Lm!a"', ["Zx81kPq0Lm!a"]),
    ('Note: auth_key = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ("Note: auth_key = Zx81kPq0Lm", ["Zx81kPq0Lm"]),
    ("Note: auth_key=Zx81kPq0Lm", ["Zx81kPq0Lm"]),
    ('const token: string = "Yt67hGw2pQx"', ["Yt67hGw2pQx"]),
    ('token: Optional[Dict[str, str]] = "Yt67hGw2pQx"', ["Yt67hGw2pQx"]),
    ("let token: &'static str = \"Yt67hGw2pQx\";", ["Yt67hGw2pQx"]),
    ("token: string | null = 'Yt67hGw2pQx'", ["Yt67hGw2pQx"]),
    ('a: str = "Zx81kPq0Lm"\napi_key: str = a', ["Zx81kPq0Lm"]),
    ('colour: str = "Zx81kPq0Lm"\ndef f(password: str)', []),
    ("secret_" + "of_the_house_" * 9 + 'x = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ("--auth-key=Zx81kPq0Lm=", ["Zx81kPq0Lm="]),
    ("password: us3r:Zx81kPq0Lm", ["us3r:Zx81kPq0Lm", "Zx81kPq0Lm"]),
])
def test_declared_and_labelled(text, literals):
    assert [text[a:b] for _, a, b in secrets.lexed_spans(text, 0.5)] == literals


@pytest.mark.parametrize("text, literals", [
    ('config["password"] = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ("os.environ['DB_PWD'] = 'Zx81kPq0Lm'", ["Zx81kPq0Lm"]),
    ('self.auth_key = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    (r'pwd = "A9\"f8Lq0zT7"', [r'A9\"f8Lq0zT7']),
    ('pwd = """Zx81kPq0Lm"""', ["Zx81kPq0Lm"]),
    ("pwd = r'Zx81kPq0Lm'", ["Zx81kPq0Lm"]),
    ('pwd = (\n    "Zx81k"\n    "Pq0Lm"\n)\n', ['Zx81k"\n    "Pq0Lm']),
    ("auth_key: >-\n  Zx81k\n  Pq0Lm\nname: x", ["Zx81k\n  Pq0Lm"]),
    ("a:\n  auth_key: |\n    Zx81kPq0Lm\n  b: c", ["Zx81kPq0Lm"]),
    ('user, password = "someone", "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ('connect(user, pwd="Zx81kPq0Lm", host="h")', ["Zx81kPq0Lm"]),
    ('base = "Zx81k"\npwd = base + "Pq0Lm"', ["Zx81k", "Pq0Lm"]),
    ('pwd = base + "Pq0Lm"\nbase = "Zx81k"', ["Pq0Lm", "Zx81k"]),
    ('api_key = later\nlater = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ('a = b\nb = a\npwd = a', []),
    ('pwd = os.getenv("DATABASE_PWD")\ncolour = "Zx81kPq0Lm"', []),
    ("It's so: the pwd isn't 'here': no = sign", []),
    ("[db]\nauth_key = Zx81kPq0Lm\nhost = x", ["Zx81kPq0Lm"]),
    ("$auth_key => 'Zx81kPq0Lm',", ["Zx81kPq0Lm"]),
    ("<user authkey=\"x\" auth-key='Zx81kPq0Lm'/>", ["Zx81kPq0Lm"]),
    ('std::string pwd = "Zx81kPq0Lm";', ["Zx81kPq0Lm"]),
    ('if pwd == "Zx81kPq0Lm": pass', []),
])
def test_source_and_configuration(text, literals):
    assert [text[a:b] for _, a, b in secrets.lexed_spans(text, 0.5)] == literals


@pytest.mark.parametrize("text, literals", [
    ('pwd = os.getenv("DATABASE_PWD", "Zx81kPq0Lm")', ["Zx81kPq0Lm"]),
    ('pwd = base64.decode("Zx81kPq0Lm", "utf-8").strip()', ["Zx81kPq0Lm"]),
    ('pwd = str(decode(get("DATABASE_PWD1", "Zx81kPq0Lm")))', ["Zx81kPq0Lm"]),
    ('pwd = ask("Say the pwd 1") or "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ("define('DB_PWD', 'Zx81kPq0Lm');", ["Zx81kPq0Lm"]),
    ('passwords = ["Zx81kPq0Lm", "Yt67hGw2pQx"]', ["Zx81kPq0Lm", "Yt67hGw2pQx"]),
    ("auth_keys:\n  - Zx81kPq0Lm\n  - production\n  - 'Yt67hGw2pQx'\n", ["Zx81kPq0Lm", "Yt67hGw2pQx"]),
    ('pwd = given or "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ('base = "Zx81kPq0Lm"\npwd = given || base', ["Zx81kPq0Lm"]),
    ("pwd: apples or Banana123", []),
    ('DBPWD = "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ('accesskey: "Zx81kPq0Lm"', ["Zx81kPq0Lm"]),
    ('keys = "Zx81kPq0Lm8sB"', ["Zx81kPq0Lm8sB"]),
    ('monkey = "Zx81kPq0Lm8sB"\ntokenizer = "Zx81kPq0Lm8sB"', []),
    ('a = "Zx81k"\npwd = f"{a}Pq0Lm"', ["Zx81k", "{a}Pq0Lm"]),
    ('A=Zx81kPq0\nDB_PWD="${A}Lm"', ["Zx81kPq0", "${A}Lm"]),
    ('pwd = "Zx81"\npwd += "kPq0Lm"', ["Zx81", "kPq0Lm"]),
    ("$pwd = 'Zx81';\n$pwd .= 'kPq0Lm';", ["Zx81", "kPq0Lm"]),
    ("$pwd = 'Zx81' . 'kPq0Lm';", ["Zx81' . 'kPq0Lm"]),
    ('passphrase = "copper violin harbour mistake"', ["copper violin harbour mistake"]),
    ('password_hint = "copper violin harbour mistake"\npassword = "enter the password of your account"', []),
    ("token = next(\"expected_identifier\")", []),
])
def test_calls_lists_and_defaults(text, literals):
    assert [text[a:b] for _, a, b in secrets.lexed_spans(text, 0.5)] == literals
    assert not any(x in secrets.redacted(text, 0.5, "#") for x in literals)


def test_long_literals_score_as_whole_ones():
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choices("abcXYZ0189-_é\U0001f511" if r.random() < 0.8 else "x", k=r.randrange(1, 900))) + r.choice(["", " ", ">", "}}"])
        text = r.choice(["", "your-", "<", "{{"]) + text
        cuts = sorted(r.choices(range(len(text) + 1), k=3))
        made = secrets.Literal([secrets.Literal.of(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])])
        made = secrets.Literal([made, secrets.Literal.of("")])
        assert made.n == len(text) and abs(made.score() - secrets.literal_score(text)) < 1e-9


def test_growing_chains_take_linear_time():
    for text in ("\n".join(["k0 = 'Zx81kPq0Lm'", *(f"k{i + 1} = k{i} + 'Ab{i}'" for i in range(20000)), "api_key = k20000"]), "pwd = 'Zx81kPq0Lm'\n" + "pwd += 'Ab1'\n" * 20000):
        began = time.process_time()
        found = secrets.lexed_spans(text, 0.5)
        assert len(found) == 20001 and time.process_time() - began < 6


def test_propagation_by_brute_force():
    """Constants given to names in random order, each through a chain of names."""
    r = random.Random(9)
    for _ in range(60):
        n, lines, want = r.randrange(1, 6), [], set()
        for k in range(n):
            literal, steps = "".join(r.choices("abcdefXYZ0123456789", k=12)) + f"q{k}", r.randrange(1, 7)
            names = [f"v{k}_{i}" for i in range(steps)]
            lines.append(f'{names[0]} = "{literal}"')
            lines += [f"{b} = {a}" for a, b in zip(names, names[1:])]
            target = r.choice([f"api_key{k}", f"colour{k}"])
            lines.append(f"{target.replace('key', '_key_')} = {names[-1]}")
            if "key" in target:
                want.add(literal)
        r.shuffle(lines)
        text = "\n".join(lines)
        assert {text[a:b] for _, a, b in secrets.lexed_spans(text, 0.3)} == want


def test_redaction_of_declared():
    out = secrets.redacted('const token: string = "Yt67hGw2pQx"; api_key: str = "sk-Live9Qx72LmPz0aR"', 0.5, "[REDACTED]")
    assert "Yt67" not in out and "Live9" not in out


def test_long_names_and_chains_take_linear_time():
    for text in ("a" * 10**6, "token:" * 10**5 + "x", "a: b[" * 10**5, "'" * 10**5 + "=", "1" * 10**6 + "=x", "'\\'" * 10**5 + "=", '"""\\' * 10**5, "a = b + " * 10**5, "a, " * 10**5 + "= 1", "a = a\n" * 10**4, "k: >\n" * 10**4, "x = (" * 10**5, "a = f(" * 10**5, "a = " + "f(" * 10**5, "a = [" * 10**5, 'f("a", ' * 10**5, "a = b or " * 10**5):
        assert secrets.lexed_spans(text + " =", 0.5) is not None


def test_redaction(edge):
    out = {r.doc_id: r for r in secrets.redact_secrets(edge).collect()}
    assert secrets.redact_secrets(edge).columns == edge.columns and secrets.redact_secrets(edge).count() == edge.count()
    assert out[18].text.startswith("password = [REDACTED] [REDACTED] [REDACTED]") and out[18].n_chars == len(out[18].text)
    assert out[1].text is None and out[6].text == dict(edge_texts())[6]


def test_leaks(spark, documents, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(i, r.item_id) for r in items.collect() for i, t in texts.items() if t and r.text in t}
    found = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, SF).collect()}
    assert held and found == held
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items, index_bytes=2000).collect()} == held  # many index blocks
    kept = {r.doc_id for r in decontaminate.drop_contaminated(documents, items).collect()}
    assert kept == texts.keys() - {i for i, _ in held}


def test_leak_edges(spark, edge, empty):
    schema = "item_id long, text string, score double"
    items = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "What is the colour of the evening sky? It is deep violet.", None), (3, "What is the colour of the evening sky? It is deep violet.", None), (4, "Paris is old.", 0.0)], schema)
    docs = spark.createDataFrame(rows_of([(1, "x " * 300 + "WHAT is the colour -- of the evening sky? It is deep violet!" + " y" * 500), (2, "What is the colour of the evening sky? It is green."), (None, "Paris is old."), (3, None)]), SCHEMA)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 3), (None, 4)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {2, 3}
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(edge, items.where("false")).collect() == []
    assert decontaminate.drop_contaminated(edge, items.where("false")).count() == edge.count()
    assert Row(doc_id=2) is not None


def test_retrieval_equals_full_scores(spark, texts):
    """Block-max pruning loses no item that plain BM25 lifts to the threshold."""
    import numpy as np

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    (((_, buffer),),) = decontaminate.passes(decontaminate.indexes(items, 0.3, 1 << 20)[0], 1 << 30)
    index = decontaminate.Index(buffer)
    n = 0
    for t in list(texts.values())[:80]:
        hashed, _ = decontaminate.tokens([(t or "").encode()])
        place = index.places(hashed)
        terms = np.unique(place[place >= 0])
        if not len(terms):
            continue
        full = np.zeros(index.n)
        for k in terms:
            full[index.item[index.first[k] : index.last[k]]] += index.impact[index.first[k] : index.last[k]]
        want = [i for i in range(len(full)) if full[i] >= 1 - 1e-6]
        assert [i for i, _ in index.retrieve(terms)] == want
        n += len(want)
    assert n
