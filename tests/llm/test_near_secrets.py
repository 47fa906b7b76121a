"""SimHash components and secret scans."""

import hashlib
import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import types as T

from plumbline.llm import queries as Q
from plumbline.llm import secrets as S
from plumbline.llm import simhash as H

KIND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("component_id", T.StringType())])


def fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    """Smallest id reachable, by comparing all with all."""
    ids, v = np.array(list(fps)), np.array(list(fps.values()), np.uint64)
    label = np.arange(len(ids))
    near = np.bitwise_count(v[:, None] ^ v[None]) <= radius
    while True:
        low = np.where(near, label[None], len(ids)).min(axis=1)
        if (low == label).all():
            break
        label = low
    best = {}
    for k, i in zip(label, ids, strict=True):
        best[k] = min(best.get(k, i), i)
    return {int(i): int(best[k]) for k, i in zip(label, ids, strict=True)}


def test_near_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: fingerprint(t) for i, t in docs.items()}
    rows = Q.op7_simhash_tiles(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{v:016x}" for i, v in want.items()}
    assert {r.doc_id: r.component_id for r in rows} == components(want)
    assert len({r.component_id for r in rows}) < len(docs)


def test_links_of_dense_fingerprints(spark):
    """Thousands within a few bits, chains, and all ones and zeros; tiles smaller than a group."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(3000)], np.uint64)
    v = np.unique(np.concatenate([base[rng.integers(0, 40, 3000)] ^ flips, np.array([0, 1, 2**64 - 1, 2**64 - 8], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "__fp long")
    old, H.TILE = H.TILE, 64
    try:
        got = {r.node: r.root for r in H.components(H.near_links(df)).collect()}
    finally:
        H.TILE = old
    want = components(dict(enumerate(v.tolist())))
    node = v.view(np.int64)
    mine = {i: got.get(int(node[i]), int(node[i])) for i in range(len(v))}
    groups = lambda m: sorted(sorted(i for i in m if m[i] == g) for g in set(m.values()))
    assert groups(mine) == groups(want)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "src long, dst long")
    got = {r.node: r.root for r in H.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_components_across_partitions_and_stretches(spark):
    """Trees, cycles and hubs of every size, links both ways and repeated, joined up in short stretches of many partitions."""
    rng = np.random.default_rng(11)
    links = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, (40, 2))] * 2
    links += [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))]
    links += [(5000, int(i)) for i in rng.permutation(np.arange(5001, 5400))] + [(i + 1, i) for i in range(7000, 7100)] + [(7000, 7100)]
    root = {n: n for p in links for n in p}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for stretch, parts in ((3, 9), (1 << 19, 1)):
        df = spark.createDataFrame(links, "src long, dst long").repartition(parts)
        got = {r.node: r.root for r in H.components(df, stretch=stretch).collect()}
        assert got == {n: r for n, r in root.items() if n != r}


def test_near_cases(spark):
    rows = [(5, None, "x", "y"), (4, "", "x", "y"), (3, " \n", None, None), (2, "one two", "x", "y"), (1, "ONE\ttwo", "x", "y"), (1, "ONE\ttwo", "x", "y"), (None, "alone in here", "x", "y"), (9, "w " * 150_000, "x", "y")]
    df = spark.createDataFrame(rows, KIND)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in H.near_components(df).collect()}
    f = lambda t: f"{fingerprint(t):016x}"
    assert got == {(5, "0" * 16, 3), (4, "0" * 16, 3), (3, "0" * 16, 3), (2, f("one two"), 1), (1, f("one two"), 1), (None, f("alone in here"), None), (9, f("w w w w"), 9)}
    kept = H.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 3), (True, 9)]
    assert H.near_components(spark.createDataFrame([], KIND)).collect() == [] == H.one_of_each(spark.createDataFrame([], KIND)).collect()


def base_spans(text):
    out = []
    for kind, pattern, least, flags in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 18, 0),
        ("hex", r"[0-9a-f]+", 16, 0),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if len(m[2] if kind == "assign" else m[0]) >= least]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_secret_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op8_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_spans(docs[r.doc_id] or "")
        said = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert set(said) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_assign for r in rows) > 0


def literals(text):
    return {text[a:b] for kind, a, b in S.spans(text) if kind == "literal"}


def test_assignments_in_many_syntaxes():
    v = "Zk8#qLm2!vR7tY"
    for line in (f'db_password = "{v}"', f"client-secret: '{v}'", f'{{"dbPassword": "{v}", "user": "anna"}}', f"export AUTH_TOKEN={v}", f"signingKey := `x`\nPrivateKey => '{v}'", f'val privateKey = "{v}"'):
        assert v in literals("x\n" + line + "\ny"), line
    assert literals('part = 1\napi_secret = "Zk8qLm2vR" + "7tYpW3nB"') == {"Zk8qLm2vR", "7tYpW3nB"}


def test_constants_are_followed():
    text = 'K1 = "Zk8qLm2vR7tYpW3n"\nalias = K1\nother = "hello world"\npassword = alias\n'
    assert literals(text) == {"Zk8qLm2vR7tYpW3n"}
    assert literals('a = b\nb = a\npassword = a\n') == set()


def test_placeholders_and_plain_names_are_left_alone():
    for line in ('password = "changeme"', "token = ${TOKEN}", 'secret: "<your secret>"', 'title = "Zk8qLm2vR7tYpW3n"', "password = None", 'keyboard = "Zk8qLm2vR7tYpW3n"', "The password: it is said."):
        assert literals(line) == set(), line


def test_secret_cases(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "Ä token=abcdefghijkl0123 " + "x" * 200_000, "x", "y"), (3, "Ä token=abcdefghijkl0123 " + "x" * 200_000, "x", "y"), (None, "ſecret=abcdefghijkl0123", "x", "y")]
    df = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.secret_scan(df).collect()}
    assert got[1] == got[2] == [] and got[3][0] == ("assign", 2, 24) and not [s for s in got[None] if s[0] == "assign"]
    clean = {r.doc_id: r.text for r in S.secret_scan(df, redact=True).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3].startswith("Ä <assign> x")
    assert S.secret_scan(spark.createDataFrame([], KIND)).collect() == []


def test_one_of_each_keeps_texts_of_null_and_repeated_ids(spark):
    """Different texts without an id, or of one id, are components of their own; equal rows and near ones come down to one."""
    texts = [f"text {i} of its own: " + " ".join(f"w{i}x{j}" for j in range(40)) for i in range(8)]
    rows = [(None, t, "x", "y") for t in texts[:5]] + [(1, texts[5], "x", "y"), (1, texts[6], "x", "y"), (1, texts[6], "x", "y"), (None, texts[6], "x", "y"), (2, texts[7], "x", "y"), (None, texts[7].upper(), "x", "y")]
    kept = H.one_of_each(spark.createDataFrame(rows, KIND)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([*((None, t) for t in texts[:5]), (1, texts[5]), (1, texts[6]), (2, texts[7])], key=key)


def test_assignments_by_subscript_type_prefix_and_triple_quotes():
    v = "Zk8qLm2vR7tY"
    for line in (
        f'config["password"] = "{v}"', f"os.environ['API_TOKEN'] = '{v}'", f'password: str = "{v}"', f'const secret: string = "{v}"', f'token: str | None = "{v}"', f'password: Dict[str, List[str]] = "{v}"',
        f'password = b"{v}"', f"password = r'{v}'", f'password = f"{v}"', f'password = """{v}"""', f"password = '''\n  {v}\n'''", f'x = """\npassword = "{v}"\n"""', f'settings: password = "{v}"',
    ):
        assert v in literals("x\n" + line + "\ny"), line
    assert literals('password = f"{get_password(1)}"') == set()


def test_every_literal_of_a_name_is_followed():
    assert literals('K = "Zk8qLm2vR7tYpW3n"\npassword = K\nK = ""\n') == {"Zk8qLm2vR7tYpW3n"}
    assert literals('K = "Zk8qLm2vR7tYpW3n"\nJ = "Ab8qLm2vR7tYpW3n"\nalias = K\nalias = J\npassword = alias\n') == {"Zk8qLm2vR7tYpW3n", "Ab8qLm2vR7tYpW3n"}


V = "Zk8qLm2vR7tY9xW"
#: Ways to write a sensitive name with a literal, and ways that give none.
FORMS = (
    'var secretKey string = "%s"', '<add key="password" value="%s"/>', "<property name='secretKey' value='%s'/>", "<password>%s</password>", 'password = A + "%s"', 'key = getenv("API_KEY", "%s")',
    'password = os.getenv("DB_PW", "%s")', "token = `%s`", 'password = Foo("%s")', 'connect(host="h", password="%s")', "login('user', password = '%s')", '{"a": {"client_secret": "%s"}}', 'set password "%s"',
    "--password=%s", "--password %s", 'String password = new String("%s");', "password: |\n  %s", 'if password == "%s":', 'let password: Option<&str> = Some("%s");', "PASSWORD ?= %s", 'setPassword("%s")',
    'headers = {"Authorization": "Bearer %s"}', 'opts.put("password", "%s")', 'password = os.environ.get("X") or "%s"', "define('DB_PASSWORD', '%s');", 'class A:\n  K = "%s"\npassword = A.K', "don't say password: %s",
)
PLAIN = ('password = os.getenv("DB_PASSWORD_NAME_1")', 'colour = "%s"', "the token of the day is %s", 'x: str = "%s"\npassword: str', 'password = ""', 'label: "%s"  # password field', 'f(password=None, name="%s")')


def test_forms_of_source_and_configuration():
    for form in FORMS:
        text = "x\n" + form % V + "\ny"
        assert V in literals(text), form
        [(a, b)] = {(a, b) for kind, a, b in S.spans(text) if kind == "literal"}
        assert text[a:b] == V
    for form in PLAIN:
        assert not literals("x\n" + (form % V if "%s" in form else form) + "\ny"), form


def test_made_files_against_what_was_put_in():
    """Brute force from the other side: files made of lines with known literals give exactly the sensitive ones."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789") for _ in range(n)) + "q7Z"
    for _ in range(150):
        lines, want = [], set()
        for k in range(rng.randrange(1, 25)):
            v, kind = word(16), rng.randrange(6)
            if kind == 0:
                lines.append(rng.choice(FORMS[:10] + FORMS[10:16] + FORMS[17:22]) % v)
                want.add(v)
            elif kind == 1:
                lines.append(f'{rng.choice(["colour", "path", "title"])}{k} = "{v}"')
            elif kind == 2:
                lines.append(f'CONST_{k} = "{v}"\nalias_{k} = CONST_{k}\ndb_password = alias_{k}')
                want.add(v)
            elif kind == 3:
                lines.append(f"some words about {v} and nothing else, it's told")
            elif kind == 4:
                lines.append(f'{{"name{k}": "{v}", "n": {k}}}')
            else:
                lines.append(f'return format("{v}", {k})')
        rng.shuffle(lines)
        got = literals("\n".join(lines))
        assert got == want, [x for x in lines if any(v in x for v in got ^ want)]


def test_long_texts_take_time_in_proportion():
    for text in ("\n".join(f"a{i}=a{i + 1}" for i in range(100_000)) + "\npassword=a0", "password " * 200_000, '"' * 300_000 + "password", "password = " + "(" * 200_000, '"""\npassword=' * 50_000, "password = a" + " + a" * 100_000, "<password>" * 100_000 + "</x>", "a:" * 200_000 + "password", "password=1 " + "f(a" * 330_000, "token=1;" + "f(a," * 200_000 + ")" * 200_000, "token=1;" + 'setToken("v4lueXyz99q",' * 43_000 + ")" * 43_000, "token=1 " + '--token f("v4lueXyz99q",' * 41_000):
        at = time.time()
        S.spans(text)
        assert time.time() - at < 15, text[:30]


def test_names_of_files_and_types_are_no_secrets():
    for text in ('password_file = "/etc/app/Secret1.txt"', 'token_type = "Bearer9xTokenQ"', 'csrf_token_name = "Abc123xyz!Q"'):
        assert S.literal_spans(text) == []
    text = '$password = ConvertTo-SecureString "S3cretV4lue99"'
    assert [text[a:b] for _, a, b in S.literal_spans(text)] == ["S3cretV4lue99"]


def test_calls_in_calls():
    for text in ('put("password", encode("S3cretV4lue99"))', 'if check("password", "S3cretV4lue99"):', 'setToken(b64(put("a", "S3cretV4lue99")))', "def f(password='S3cretV4lue99'): pass", 'f({"token": "S3cretV4lue99"})'):
        assert [text[a:b] for _, a, b in S.literal_spans(text)] == ["S3cretV4lue99"], text
