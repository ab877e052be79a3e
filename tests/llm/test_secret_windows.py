"""Random stretches inside longer runs, against a loop over all windows."""

import numpy as np
import pyarrow as pa
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from ledgerline.llm import secrets
from ledgerline.llm.textwords import utf8

KEY = "kJ8sD2nQx7Lw0ZpR4tVb"
WORDS = "the-quick-brown-fox-jumps-over-the-lazy-dog"


def ratio_of():
    """Random: upper-case letters and digits next to anything; ordinary: all other transitions."""
    odd = np.zeros(256)
    odd[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = 1
    return (6 * np.maximum(odd[:, None], odd[None, :]) - 2).ravel()


RATIO = ratio_of()


def found(text):
    body, rows = utf8(pa.array([text], pa.string()))
    kind, start, end = secrets.all_spans(body, rows, RATIO)
    return [(int(s), int(e)) for k, s, e in zip(kind, start, end, strict=True) if k == 3]


def plain(run):
    """Spans of one run: all of it by its mean, else the windows, overlapping ones joined."""
    if run.isdigit() or len(run) < secrets.MIN_RUN:
        return []
    raw = run.encode()
    scores = [RATIO[a * 256 + b] for a, b in zip(raw, raw[1:], strict=False)]
    if sum(scores) / len(scores) >= secrets.THRESHOLD:
        return [(0, len(run))]
    out = []
    for i in range(len(scores) - secrets.MIN_RUN + 1):
        window = run[i : i + secrets.MIN_RUN + 1]
        if sum(scores[i : i + secrets.MIN_RUN]) >= secrets.WINDOW_THRESHOLD * secrets.MIN_RUN and not window.isdigit():
            if out and i <= out[-1][1] - 1:
                out[-1] = (out[-1][0], i + len(window))
            else:
                out.append((i, i + len(window)))
    return out


def test_key_joined_to_words():
    for joint in "/-_=":
        text = f"see {WORDS}{joint}{KEY}{joint}{WORDS} there"
        spans = found(text)
        assert len(spans) == 1 and KEY in text[slice(*spans[0])]
        assert spans[0][1] - spans[0][0] < len(KEY) + 2 * secrets.MIN_RUN
    two = f"{WORDS}{WORDS}-{KEY}-{WORDS}{WORDS}-{KEY}-{WORDS}{WORDS}"
    assert len(found(two)) == 2
    assert found(f"{WORDS} {WORDS}/{WORDS}") == []
    assert found(f"{'word' * 30}-{'1234567890' * 2}"[:80]) == plain(f"{'word' * 30}-{'1234567890' * 2}"[:80])
    assert found("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="gGzZ19-_/", min_size=0, max_size=60), max_size=4))
def test_windows_equal_a_loop(parts):
    text, want = "", []
    for part in parts:
        run = "".join(c for c in part)
        want += [(len(text) + s, len(text) + e) for s, e in plain(run)]
        text += run + " "
    body, rows = utf8(pa.array([text], pa.string()))
    assume(not len(secrets.base_spans(body, rows)[0]))  # a run that touches a pattern's span is left to it
    assert found(text) == want


def test_long_text_and_redaction():
    text = f"{WORDS}/{KEY}/{WORDS} " * 2000
    assert len(found(text)) == 2000
    masked = secrets.redacted_text(pa.array([text, None, ""], pa.string()), RATIO).to_pylist()
    assert KEY not in masked[0] and masked[0].count("[REDACTED]") == 2000 and masked[1:] == [None, ""]
