import base64
import json
import timeit

import pytest

from tablewright.llm import secret_scan
from tablewright.llm.secret_scan import confirmed_spans
from tests.llm.test_search import PKCS8, RSA, SSH, b64


def wrapped(data, width, by):
    text = b64(data)
    return by.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("by", ["\n", "\r\n", "\\n", "\\r\\n", "\\\\n", "\n    "])
def test_keys_over_several_lines(by):
    for data in (RSA, PKCS8, SSH + bytes([0, 0, 0, 40]) + bytes(40)):
        for width in (64, 76):
            for before, after in (("é key: ", " end"), ("word" + by, by + "word"), ("Zq" * 32 + by, by + "Qz" * 32)):
                body = wrapped(data, width, by)
                found = secret_scan.wrapped_spans(before + body + after)
                assert [(a, b) for _, a, b in found] == [(len(before), len(before + body))], (by, width, before)
                assert secret_scan.mask(before + body + after) == before + "[SECRET]" + after
    assert secret_scan.wrapped_spans(wrapped(bytes(range(1, 255)) * 2, 64, by)) == []
    assert secret_scan.wrapped_spans(wrapped(RSA + b"\0\0\0", 64, by)) == []


def test_pem_with_escaped_breaks():
    for by in ("\n", "\\n", "\\r\\n"):
        key = f"-----BEGIN RSA PRIVATE KEY-----{by}{wrapped(RSA, 64, by)}{by}-----END RSA PRIVATE KEY-----"
        assert ("pem", 4, 4 + len(key)) in secret_scan.confirmed_spans("k='é" + key + "' z")
        assert secret_scan.mask("k='é" + key + "' z") == "k='é[SECRET]' z"


def test_many_lines_are_scanned_in_linear_time():
    text = "\n".join(["M" + "I" * 63] * 20_000) + "z" * 200_000
    assert secret_scan.wrapped_spans(text) == []


LONG_TEXTS = {
    "token starts": "eyJ" * 1_700_000,
    "token starts and dots": "eyJa." * 1_000_000,
    "key lines": ("MIP/" + "A" * 60 + "\n") * 77_000,
    "marks without ends": "-----BEGIN PRIVATE KEY-----\n" * 180_000,
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_time_grows_with_the_text(name):
    text = LONG_TEXTS[name]
    small, large = (min(timeit.repeat(lambda: confirmed_spans(text[:n]), number=1, repeat=2)) for n in (len(text) // 8, len(text)))
    assert confirmed_spans(text) == []
    assert large < 24 * small + 0.5  # 64 times, were it quadratic


def test_token_after_a_start_that_is_none():
    part = lambda data: base64.urlsafe_b64encode(data).decode().rstrip("=")
    token = f'{part(json.dumps({"alg": "HS256"}).encode())}.{part(b"{}")}.{part(bytes(range(32)))}'
    text = f"eyJ eyJa. {token} eyJ"
    assert confirmed_spans(text) == [("jwt", 10, 10 + len(token))]
