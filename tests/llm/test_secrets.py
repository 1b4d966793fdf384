import hashlib
import random
import re
import string
import time

from lithoscope.llm import secrets as sc

KEY = "AKIA" + "ABCDEFGHIJ123456"
TEXTS = [None, "", "plain words", f"PASSWORD = 'abcDEF123456' {KEY} x", "api_key: short", 'token="0123456789abcdef0123"', "AKIA123", "deadbeef" * 4 + " DEADBEEF", "ſecret=abcdefghijklmnop", "é secret : Zm9vYmFyYmF6 " + "f" * 16]
TEXTS += ["x" * 200_000 + " apikey=abcdefghijkl.mnop"]


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 12)
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_base_kinds(docs):
    got = {r.doc_id: r for r in sc.scan_secrets(docs(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(sc.shown(want).encode()).hexdigest()
        assert {(s.start, s.end) for s in got[i].spans if s.kind != "literal"} == {(w[0], w[2]) for w in want}
    assert sc.scan_secrets(docs([])).count() == 0
    assert sc.scan_secrets(docs([(1, TEXTS[3]), (1, TEXTS[3]), (None, TEXTS[3])])).count() == 3


def literals(text):
    return [text[a:b] for a, b in sc.literal_spans(text)]


def test_assignments():
    assert literals('db_password := "hunter2-Xy9!kq"') == ["hunter2-Xy9!kq"]
    assert literals('{"clientSecret": "q8Zp-11xKw_a"}') == ["q8Zp-11xKw_a"]
    assert literals("<auth_token>Zx81kQp0Lm2w</auth_token>") == ["Zx81kQp0Lm2w"]
    assert literals('title = "Hello-World-99x"') == []
    assert literals('password_file = "/etc/secrets/x9A"') == [] and literals('password = "changeme"') == []


def test_constants_are_propagated():
    text = 'a = "hunter2-Xy9!kq"\nb = a\ntitle = "Other-Value-77z"\ndb_password = b\n'
    assert literals(text) == ["hunter2-Xy9!kq"]
    assert literals('base = "hunter2-Xy9!kq"\npage = base') == []
    chain = 'n0 = "hunter2-Xy9!kq"\n' + "".join(f"n{'x' * k} = n{'x' * (k - 1) or '0'}\n" for k in range(1, 5))
    assert literals(chain + "secret = nxxxx") in (["hunter2-Xy9!kq"], [])
    loop = 'a = b\nb = a\nc = "hunter2-Xy9!kq"\na = c\nsecret = b'
    assert literals(loop) == ["hunter2-Xy9!kq"]


def test_names_with_digits_are_propagated():
    assert literals('part1 = "hunter2-Xy9!kq"\npassword = part1') == ["hunter2-Xy9!kq"]
    chain = 'n0 = "hunter2-Xy9!kq"\n' + "".join(f"n{k} = n{k - 1}\n" for k in range(1, 5))
    assert literals(chain + "secret = n4") == ["hunter2-Xy9!kq"]
    assert literals('s3_value = "hunter2-Xy9!kq"\npage = s3_value') == []


def test_options_of_command_lines():
    for line in ("run --access-key=q8Zp11xKw9aTz x", "--access-key=q8Zp11xKw9aTz", 'run --passphrase="q8Zp11xKw9aTz"', '["--pwd=q8Zp11xKw9aTz"]', 'cmd = "run --auth-key=q8Zp11xKw9aTz"', "run -pwd=q8Zp11xKw9aTz"):
        assert literals(line) == ["q8Zp11xKw9aTz"], line
    assert literals('run --args="--access-key=q8Zp11xKw9aTz"') == ["q8Zp11xKw9aTz"]
    assert literals("run --env=SECRET_KEY=q8Zp11xKw9aTz") == ["q8Zp11xKw9aTz"]
    assert literals('part1 = "q8Zp11xKw9aTz"\nrun --pwd=$part1') == ["q8Zp11xKw9aTz"]
    assert literals("run --title=q8Zp11xKw9aTz ---pwd=q8Zp11xKw9aTz") == []


def test_long_element_values():
    value = "Zx81+kQp0/Lm2w" * 1000
    assert literals(f"<private_key>{value}</private_key>") == [value]
    assert literals(f"<private_key>{value}") == [] and literals(f"<private_key>{value}\n</private_key>") == []


VALUE = "q8Zp-11xKw_a"


def test_nested_and_block_values():
    for text in (
        f"password: |\n  {VALUE}\n  Zz9-second-Line1\nother: x",
        f'"password": ["{VALUE}", "Zz9-second-Line1"]',
        f"passwords:\n  - {VALUE}\n  - 'Zz9-second-Line1'\nhost: a",
        f'password = """{VALUE}\nZz9-second-Line1"""',
        f"tokens = ['{VALUE}',\n  'Zz9-second-Line1',\n]",
    ):
        assert literals(text) == [VALUE, "Zz9-second-Line1"], text


def test_forms_of_one_literal():
    for text in (
        f"password {VALUE}", f"machine a.b login me password {VALUE}", f"run --password {VALUE}", f'password = b"{VALUE}"', f"password = r'{VALUE}'",
        f'password: str = "{VALUE}"', f'char password[] = "{VALUE}";', f'var password string = "{VALUE}"', f'String password = "{VALUE}";', f'config["password"] = "{VALUE}"',
        f"'password' => '{VALUE}',", f"define('DB_PASSWORD', '{VALUE}');", f'setProperty("db.password", "{VALUE}")', f'- name: DB_PASSWORD\n  value: {VALUE}\n', f'{{"name": "db_password", "value": "{VALUE}"}}',
        f'<add key="password" value="{VALUE}"/>', f"<password><value>{VALUE}</value></password>", f"credentials:\n  value: {VALUE}\n", f"[secret]\nvalue = {VALUE}\n", f'{{"token": {{"data": "{VALUE}"}}}}',
        f'# password = "{VALUE}"', f"// password: {VALUE}", f"/* password={VALUE} */", f"<!-- <password>{VALUE}</password> -->", f'password = decode("{VALUE}")',
        f'password = os.getenv("DB_PASSWORD", "{VALUE}")', f'def connect(password="{VALUE}"):\n  pass', f"note: password = {VALUE}", f"url = 'x'; password = '{VALUE}' # mine", f"export PASSWORD={VALUE}",
    ):
        assert literals(text) == [VALUE], text


def test_joined_strings_are_one_literal():
    assert literals('password = "q8Zp" + "-11x" + "Kw_a"') == ["q8Zp", "-11x", "Kw_a"]
    assert literals('password = ("q8Zp"\n  "-11xKw_a")') == ["q8Zp", "-11xKw_a"]
    assert literals('password = "q8" + "Zp"') == []


def test_order_scope_and_comments_in_propagation():
    assert literals(f'a = "First-Value-77z"\na = "{VALUE}"\npassword = a') == [VALUE]
    assert literals(f'a = "{VALUE}"\npassword = a\na = "Later-Value-77z"') == [VALUE]
    assert literals(f'password = a\na = "{VALUE}"') == [VALUE]
    assert literals(f'def f():\n    a = "Inner-Value-77z"\n\ndef g():\n    password = a\n\na = "{VALUE}"\n') == [VALUE]
    assert literals(f'function f() {{ var a = "Inner-Value-77z"; }}\nvar a = "{VALUE}";\nfunction g() {{ password = a; }}') == [VALUE]
    assert literals(f'# a = "Old-Value-77z"\na = "{VALUE}"\npassword = a') == [VALUE]
    assert literals(f'a = "{VALUE}"\n# password = a') == []
    assert literals('a = "Some-Value-77z"\npassword_length = a') == []


def test_prose_and_harmless_values_are_left_alone():
    for text in (
        "password recovery\ntoken economics\nThe key: a longer explanation of authorship", "secret: changeme", "key = value", "password = input('Password: ')", "password = os.environ['DB_PASSWORD']",
        "password: ${DB_PASSWORD}", "tokens: 128", "author: Charlotte9", "primary_key: identifier", 'token_url = "https://a.b/Q9xx77/tok"', "password", "'" * 50 + "password", "password = " + "(" * 2000,
    ):
        assert literals(text) == [], text


def planted(n=1500, seed=21):
    """Texts with one planted literal under a sensitive name, and as many with one under a harmless name."""
    rng = random.Random(seed)
    letters = string.ascii_letters + string.digits
    forms = [
        '{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "{n}={v}", "--{n}={v}", "<{n}>{v}</{n}>", "{n} := `{v}`", "'{n}' => '{v}',", "{n}: |\n  {v}\n", '"{n}": [\n  "{v}"\n]',
        '{n} = """{v}"""', "{n}:\n  - {v}\n", 'c["{n}"] = "{v}"', "- name: {n}\n  value: {v}", '// {n} = "{v}"', 'tmp = "{v}"\n{n} = tmp', 'f("{n}", "{v}")', "{n} {v}",
    ]
    secret = ["password", "db_passwd", "apiKey", "API_TOKEN", "clientSecret", "private_key", "auth-key", "aws.secret.access_key", "passphrase", "signingKey"]
    plain = ["title", "user_name", "colour", "build-id", "image.digest", "etag", "sessionName", "password_hint", "token_count", "monkey"]
    out = []
    for k in range(2 * n):
        value = "".join(rng.choice(letters) for _ in range(rng.randint(12, 40))) + "7x"
        form, name = rng.choice(forms), rng.choice(secret if k < n else plain)
        before = "".join(f"line{j} = {rng.randint(0, 9)}\n" for j in range(rng.randint(0, 4)))
        out.append((before + form.format(n=name, v=value) + "\nend = 1\n", value, k < n))
    return out


def test_recall_and_precision_on_planted_literals():
    right = wrong = missed = 0
    for text, value, is_secret in planted():
        found = literals(text)
        right += is_secret and value in found
        missed += is_secret and value not in found
        wrong += sum(f != value for f in found) if is_secret else len(found)
    recall, precision = right / (right + missed), right / (right + wrong)
    print(f"recall {recall:.4f} precision {precision:.4f}")
    assert recall >= 0.98 and precision >= 0.98


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        text = "".join(f'a{k % 50} = "value{k}"\n/* x */ password = a{k % 50} "don\'t {{ (\n' for k in range(n // 20))
        began = time.perf_counter()
        sc.literal_spans(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    minified = '{"a":[' + ",".join(f'{{"k{k}":{k},"token{k}":"{VALUE}{k}"}}' for k in range(20_000)) + "]}"
    nested = "function f() {" * 20_000 + 'a = "x"; password = a; ' * 5_000
    comment = "/* " + "x * y " * 200_000 + "*/ key = 1"
    began = time.perf_counter()
    assert len(literals(minified)) == 20_000 and time.perf_counter() - began < 10
    for text in (nested, comment, '"""' + "x\\n" * 300_000 + "key", "/*" * 50_000 + " password", "(" * 100_000 + "key", '"""' * 30_000 + "key=1", "password: " * 20_000, "<a><a>" * 20_000 + "key", "key = " + "'a' + " * 30_000):
        began = time.perf_counter()
        sc.literal_spans(text)
        assert time.perf_counter() - began < 5, text[:20]


def test_other_columns_may_have_the_names_of_results(docs):
    odd = docs([(1, TEXTS[3]), (None, "")]).selectExpr("*", "'x' as spans", "1 as n_assign", "2 as base_sha256")
    got = sorted(sc.scan_secrets(odd).collect(), key=lambda r: r.doc_id is None)
    assert [(r.doc_id, r.n_assign, r.n_access) for r in got] == [(1, 1, 1), (None, 0, 0)]
