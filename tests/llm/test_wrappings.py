"""Keys in wrappings, and wrappings in wrappings: found where they were put, public values left alone."""

import base64
import json
import random
import textwrap
import time

import pytest
from test_operators import NOT_PRIVATE, PRIVATE

from alertloom.llm import secrets


def b64(b):
    return base64.b64encode(b).decode()


def pem(b, width=64):
    return "-----BEGIN PRIVATE KEY-----\n" + "\n".join(textwrap.wrap(b64(b), width)) + "\n-----END PRIVATE KEY-----\n"


FORMS = {
    "one line": b64,
    "url-safe": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "lines of 64": lambda b: "\n".join(textwrap.wrap(b64(b), 64)),
    "indented lines": lambda b: "\r\n  ".join(textwrap.wrap(b64(b), 76)),
    "escaped lines": lambda b: "\\n".join(textwrap.wrap(b64(b), 64)),
    "hex": bytes.hex,
    "upper hex": lambda b: b.hex().upper(),
    "colons": lambda b: b.hex(":"),
    "upper colons": lambda b: b.hex(":").upper(),
    "blanks": lambda b: b.hex(" "),
    "hex lines": lambda b: "\n".join(textwrap.wrap(b.hex(), 80)),
    "colon lines": lambda b: ":\n    ".join(textwrap.wrap(b.hex(":"), 45)).replace("::", ":"),
}


def sure(text):
    return {s for s in secrets.find_secrets(text) if s[3] and s[0] in secrets.ADDED_KINDS}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("name", PRIVATE)
def test_every_form_is_found_in_place(form, name):
    body = FORMS[form](PRIVATE[name])
    for before, after in (("", ""), ("é key: ", " end"), ("key:\n", "\nNext words follow here\n"), ("x = '", "' # be")):
        found = sure(before + body + after)
        assert {(a, b) for _, a, b, _ in found} >= {(len(before), len(before) + len(body))}, (before, found)


@pytest.mark.parametrize("form", FORMS)
def test_other_values_are_left_alone(form):
    for name, b in NOT_PRIVATE.items():
        if name != "two values":  # a key and more, which a form with an end of its own cuts off
            assert not sure(f"see {FORMS[form](b)} end"), name


def test_the_usual_nests():
    key = PRIVATE["pkcs8"]
    assert {k for k, *_ in sure(f"tls.key: {b64(pem(key).encode())} end")} == {"nested"}
    assert {k for k, *_ in sure(json.dumps({"private_key": pem(key)}))} == {"pem"}
    assert {k for k, *_ in sure("token: " + b64(key.hex().encode()))} == {"nested"}
    assert {k for k, *_ in sure("\n".join(textwrap.wrap(b64(pem(key).encode()), 76)))} == {"nested"}
    assert {k for k, *_ in sure(b64(json.dumps({"k": pem(key)}).encode()))} == {"nested"}
    public = NOT_PRIVATE["public"]
    assert not sure(b64(pem(public).encode())) and not sure(json.dumps({"k": pem(public)}))


@pytest.mark.parametrize("seed", range(40))
def test_random_nests(seed):
    r = random.Random(seed)
    data, name = r.choice([(b, n) for n, b in [*PRIVATE.items(), *NOT_PRIVATE.items()] if n != "two values"])
    for _ in range(r.randint(0, secrets.DEPTH - 1)):
        inner = r.choice([*FORMS.values(), pem])(data) if data in PRIVATE.values() or data in NOT_PRIVATE.values() else r.choice(list(FORMS.values()))(data)
        data = r.choice(["", "a: ", '{"x": "']).encode() + inner.encode() + b" end of it"
    body = r.choice(list(FORMS.values()))(data)
    before = "é word " * r.randint(0, 4) + "see: "
    spans = {(a, b) for _, a, b, _ in sure(f"{before}{body} zz")}
    assert ((len(before), len(before) + len(body)) in spans) == (name in PRIVATE)
    assert bool(spans) == (name in PRIVATE)


def test_redaction_takes_the_whole_wrapping(spark):
    body = b64(pem(PRIVATE["pkcs8"]).encode())
    docs = spark.createDataFrame([(1, f"a {body} b"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()} == {1: "a [SECRET] b", 2: "plain", 3: None}
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["QUFB" * 16 + "\n", "ab:" * 30, "ab cd ", "0123456789abcdef" * 5 + "\n", b64(b64(b"QUFBQUFB" * 9).encode()) + "\n", "AB" * 40 + " be ", "QUFB" * 12 + "\\n"])
def test_time_is_linear(unit):
    def run(n):
        text = unit * (n // len(unit))
        best = 9.0
        for _ in range(2):
            began = time.process_time()
            secrets.find_secrets(text)
            best = min(best, time.process_time() - began)
        return best

    small, large = run(400_000), run(1_600_000)
    assert large < 8 * max(small, 0.05)
