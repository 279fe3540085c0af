import random
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import forms, rules, secrets, storage

LOGIN = """<form id=login action="/login" method=post><input name=username><input type=password name=password><input type=hidden name=csrf value=tok123>
<input type=submit name=go value=x><input value=unnamed></form>"""
SETTINGS = """<form action="https://o.com/s?x" method=weird enctype="multipart/form-data"><input name=a value=1><textarea name=bio>Hi &amp; you</textarea>
<select name=role><option value=user>U<option value=admin selected>A</select><select name=plain><option>first<option>second</select><select name=none></select>
<input type=checkbox name=newsletter value=yes checked><input type=checkbox name=terms><input type=radio name=r value=1><input type=radio name=r value=2 checked>
<input type=checkbox name=on checked><input type=file name=f><textarea name=a>later</textarea></form>"""


def test_forms(spark, pages_of):
    nodes = forms.form_nodes(pages_of(LOGIN, SETTINGS, "<p>no form")).cache()
    found = {r.page_id: (r.selector, r.action, r.method, r.enctype) for r in forms.extract_forms(nodes).collect()}
    assert found == {0: ("form#login", "/login", "POST", "urlencoded"), 1: ("form", "https://o.com/s?x", "GET", "multipart")}
    fields = {}
    for r in forms.form_fields(nodes).collect():
        fields.setdefault(r.page_id, {})[r.name] = r.value
    assert fields == {0: {"username": "", "password": "", "csrf": "tok123"}, 1: {
        "a": "later", "bio": "Hi & you", "role": "admin", "plain": "first", "newsletter": "yes", "r": "2", "on": "on"}}


def test_fill_and_submit(spark, pages_of):
    nodes = forms.form_nodes(pages_of(LOGIN, "<form><input name=q value='a b'></form>", "<p>none")).cache()
    checks = forms.validate_fields(nodes, [("[name=username]", "me & you"), ("form", "x"), ("input[type=submit]", "é")]).cache()
    assert {(r.page_id, r.ord): r.code for r in checks.collect()} == {
        (0, 0): None, (0, 1): "FORM_NOT_FOUND", (0, 2): None, (1, 0): "SELECTOR_NOT_FOUND", (1, 1): "FORM_NOT_FOUND", (1, 2): "SELECTOR_NOT_FOUND"}
    with pytest.raises(ValueError):
        forms.validate_fields(nodes, [("[[[", "x")])
    found = forms.extract_forms(nodes)
    filled = forms.fill(forms.form_fields(nodes), found, checked := checks.filter("code IS NULL").select("page_id", "ord", "name", "value"))
    sent = {r.page_id: (r.url, r.method, r.body) for r in forms.submit_requests(found, filled).collect()}
    assert sent == {0: ("https://example.com/login", "POST", "csrf=tok123&go=%C3%A9&password=&username=me+%26+you"),
                    1: ("https://example.com/a/", "GET", "q=a+b")}
    query = {r.page_id: (r.url, r.body) for r in forms.submit_requests(found, filled, get_as_query=True).collect()}
    assert query[1] == ("https://example.com/a/?q=a+b", None) and checked.count() == 2
    overlay = spark.createDataFrame([(0, "input[name='username']", "typed")], "page_id long, key string, value string")
    values = {(r.page_id, r.key): r.value for r in forms.field_values(nodes, overlay).collect()}
    assert values[(0, "input[name='username']")] == "typed" and values[(0, "input[name='csrf']")] == "tok123" and values[(0, "input")] == "unnamed"


def secret_texts():
    jwt = ".".join(["eyJ" + "a" * 12, "b" * 14, "c" * 11])
    return jwt, "ghp_" + "A" * 36, "github_pat_" + "B" * 22, "sk-" + "d" * 24, "xoxb-" + "1" * 10 + "-" + "e" * 20


def test_redaction_round_trip(spark):
    jwt, pat, fine, openai, slack = secret_texts()
    texts = [f"a {jwt} b {jwt}", f"{pat}{fine}", "clean", f"x {openai} y {openai}zz {slack}", "CUSTOM-ABCDEFGHIJK!", ""]
    patterns = secrets.secret_patterns([("custom", "CUSTOM-[A-Z0-9]{10,}"), ("tail", "secret_[0-9a-f]+")])
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id long, text string")
    hidden = secrets.redact_text(frame, "text", patterns).cache()
    shown = {r.id: r.text for r in hidden.collect()}
    assert shown[2] == "clean" and shown[5] == ""
    assert all(s not in t for s in secret_texts() for t in shown.values()) and "CUSTOM" not in shown[4]
    vault = secrets.build_vault(frame, "text", patterns).cache()
    assert vault.count() == vault.select("handle").distinct().count() == 6  # the longer key is a secret of its own
    back = secrets.resolve_handles(hidden, "text", vault, "id")
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))
    unknown = spark.createDataFrame([(1, "x ${secret_" + "0" * 32 + "} y")], "id long, text string")
    assert secrets.resolve_handles(unknown, "text", vault, "id").first().text == unknown.first().text


@pytest.mark.parametrize("text", ["hello \ufdd0 world token = \"" + "a" * 40 + "\" end", "\ufdd0\ufdd0", "no secret \ufdd0 at all", "CUSTOM-ABCD\ufdd0CUSTOM-EFGH"])
def test_marks_in_texts_do_not_leak(spark, text):
    patterns = secrets.secret_patterns([("token", 'token = "[0-9a-f]{40}"'), ("named", "(?P<my_name>CUSTOM-[A-Z]{4})"), ("twice", r"(x)\1{5}")])
    frame = spark.createDataFrame([(1, text)], "k int, text string")
    hidden = secrets.redact_text(frame, "text", patterns)
    shown = hidden.first().text
    assert "a" * 40 not in shown and "CUSTOM-" not in shown and shown.count("\ufdd0") == text.count("\ufdd0")
    assert secrets.resolve_handles(hidden, "text", secrets.build_vault(frame, "text", patterns), "k").first().text == text


def test_any_text_comes_back(spark):
    draw = random.Random(5)
    parts = ["sk-" + "k" * 24, "ghp_" + "B" * 36, "\ufdd0", "${secret_0}", "é", "\U0001f600", "\n", " ", "xxxxxx", "token", "\x00"]
    rows = [(n, "|".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for n in range(300)]
    patterns = secrets.secret_patterns([("twice", r"(x)\1{5}")])
    frame = spark.createDataFrame(rows, "k int, text string")
    hidden = secrets.redact_text(frame, "text", patterns).cache()
    assert not any("k" * 24 in r.text or "xxxxxx" in r.text for r in hidden.collect())
    back = secrets.resolve_handles(hidden, "text", secrets.build_vault(frame, "text", patterns), "k")
    assert {r.k: r.text for r in back.collect()} == dict(rows)


def test_fields_named_through_other_elements(spark, pages_of):
    page = pages_of("<div class=login><form><input name=user><button name=b>Go</button></form></div>")
    wanted = [("div.login input", "me"), ("div.login button", "x"), ("div.other input", "y")]
    with pytest.raises(ValueError):
        forms.validate_fields(forms.form_nodes(page), wanted)
    rows = forms.validate_fields(forms.form_nodes(page, [s for s, _ in wanted]), wanted).orderBy("ord").collect()
    assert [(r.name, r.code) for r in rows] == [("user", None), (None, "FORM_NOT_FOUND"), (None, "SELECTOR_NOT_FOUND")]


def test_patterns_that_match_nothing(spark):
    with pytest.warns(UserWarning, match="empty text"):
        assert len(secrets.secret_patterns([("none", "a*")])) == 7


def test_patterns(spark):
    with pytest.warns(UserWarning, match="invalid redaction pattern"):
        patterns = secrets.secret_patterns([("bad", "[x"), ("jwt", "J+")])
    assert dict(patterns)["jwt"] == "J+" and patterns[-1][0] == "jwt" and len(patterns) == 7


def test_many_secrets_in_one_text(spark):
    marks = F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda k: F.concat(F.lit("MARK-"), F.lpad(k.cast("string"), 6, "0")))
    text = spark.range(1).select(F.concat_ws(" ", marks).alias("text"))
    began = time.monotonic()
    found = secrets.redact_text(text, "text", [("mark", "(MARK-[0-9]{6})")]).select(
        F.regexp_count("text", F.lit(secrets.HANDLE)).alias("n"), F.length("text").alias("long")).first()
    assert found.n == 20_000 and found.long == 20_000 * 43 - 1
    assert time.monotonic() - began < 25  # a search of the whole text for each match takes minutes


def test_beginnings_of_patterns():
    given = {"sk-[A-Za-z0-9]{20,}": "sk-", "gh[ps]_x": "gh", 'token = "[0-9]"': 'token = "', "ab?c": "a", "ab{2}": "a", "a*": "", "ab|cd": "",
             "(MARK)": "", r"a\.b": "a", "abc": "abc", "ab+": "a", "(?i)ab": "", "^ab": ""}
    assert {p: secrets._beginning(p) for p in given} == given


def test_cookie_and_storage_redaction(spark):
    openai = secret_texts()[3]
    rows = spark.createDataFrame([("My_SESSION_id", "v1"), ("theme", "dark"), ("note", f"k={openai}")], "name string, value string")
    found = {r.name: (r.value, r.handle) for r in secrets.redact_cookies(rows).collect()}
    assert found["My_SESSION_id"][0] == "••••••" and found["My_SESSION_id"][1].startswith("${secret_")
    assert found["theme"] == ("dark", None) and openai not in found["note"][0]
    assert {r.secret for r in secrets.cookie_vault(rows).collect()} == {"v1", openai}
    items = spark.createDataFrame([("s", "o", "k", f"x{openai}"), ("s", "o", "p", "plain")], "session string, origin string, key string, value string")
    hidden = secrets.redact_storage(items, single=True)
    assert {r.key: r.handle is not None for r in hidden.collect()} == {"k": True, "p": False}
    vault = secrets.storage_vault(items, single=True)
    assert {r.secret for r in vault.collect()} == {openai, f"x{openai}"}
    saved = storage.resolved_for_saving(hidden.drop("handle"), vault)
    assert {r.key: r.value for r in saved.collect()} == {"k": f"x{openai}", "p": "plain"}


def test_header_rules(spark):
    ruleset = spark.createDataFrame([
        (1, ["api.example.com", "*.internal.com"], {"X": "1", "Y": "1"}), (2, ["*.internal.com"], {"X": "2"})],
        "rule_no int, domains array<string>, values map<string,string>")
    asked = spark.createDataFrame([
        (1, "https://api.example.com/a", {"Y": "own"}), (2, "https://a.b.internal.com", None), (3, "https://internal.com", {"Z": "z"}), (4, "mailto:x", None)],
        "request_id long, url string, headers map<string,string>")
    found = {r.request_id: r.headers for r in rules.apply_header_rules(asked, ruleset).collect()}
    assert found == {1: {"X": "1", "Y": "own"}, 2: {"X": "2", "Y": "1"}, 3: {"Z": "z"}, 4: {}}


def test_auth_profiles(spark):
    profiles = spark.createDataFrame([("gh", "Authorization", "tok", "Bearer ", ["api.github.com", "*.github.com"])],
                                     "name string, header string, value string, value_prefix string, domains array<string>")
    asked = spark.createDataFrame([
        (1, "https://api.github.com/x", "gh"), (2, "https://raw.github.com", "gh"), (3, "https://evil.com", "gh"), (4, "https://a.com", "nope"), (5, "https://a.com", None)],
        "request_id long, url string, auth_profile string").withColumn("headers", F.create_map(F.lit("A"), F.lit("b")))
    found = {r.request_id: (r.headers.get("Authorization"), r.code) for r in rules.apply_auth_profiles(asked, profiles).collect()}
    assert found == {1: ("Bearer tok", None), 2: ("Bearer tok", None), 3: (None, "AUTH_PROFILE_DOMAIN_MISMATCH"),
                     4: (None, "AUTH_PROFILE_NOT_FOUND"), 5: (None, None)}
