"""Helpers against brute force on generated inputs."""

import gzip
import io

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import decontaminate, html_extract, quality, rules, toxicity, warc

WORDS = st.lists(st.sampled_from(["a", "b", "A.", "c d", "\n", "é"]), max_size=60).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_repeated_windows(text):
    assert rules.Stats(text).n_repeat_words == brute.repeat_words(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=4), WORDS, st.integers(2, 6))
def test_scanner(items, text, size):
    items = [(str(i), t) for i, t in enumerate(items)]
    words = decontaminate.words_of(text)
    ranges, found = decontaminate.Scanner([(i, decontaminate.words_of(t)) for i, t in items], size).hits(words)
    assert (len(words), sum(b - a for a, b in ranges), sorted(found)) == brute.leaks([(1, text)], items, size)[1]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) or len(ranges) < 2 or all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    for a, b in ranges:
        (span,) = decontaminate.spans_of(text, [[a, b]])
        assert decontaminate.words_of(text[span["start"] : span["end"]]) == words[a:b]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 3), st.booleans())
def test_records_and_gaps_cover_an_archive(junk, at, zipped):
    parts = [warc.record(b"x" * 30 * i, "http://x", i, None, "2020-01-01T00:00:00Z") for i in range(3)]
    parts = [gzip.compress(p, mtime=0) if zipped else p for p in parts]
    data = b"".join([*parts[:at], junk, *parts[at:]])
    out = list(warc.records(io.BytesIO(data)))
    ends = list(dict.fromkeys((x.start, x.stop) for x in out))  # those in one member share its span
    assert (ends == [] and not data) or (ends[0][0] == 0 and ends[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ends, ends[1:])))
    assert sum(x.kind == "record" for x in out) >= 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "<li>", "<td>", "<script>", "</script>", "<!--", "-->", "text ", "&amp;", "<", ">", "<a href=x", "'", '"', "</", "<article>", "&#x41;"]), max_size=40).map("".join))
def test_any_markup_is_parsed(source):
    nodes, blocks = html_extract.parse(source)
    assert nodes[0].text == sum(len(t) for _, t in blocks) and all(" ".join(t.split()) == t for _, t in blocks)
    assert html_extract.features(nodes, {"ad": -2.0}).shape == (len(nodes), html_extract.WIDTH)
    html_extract.decode(nodes, np.ones(len(nodes)))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_statistics_and_decoding_take_any_text(text):
    assert len(quality.statistics(text)) == quality.N_FEATURES and np.isfinite(quality.statistics(text)).all()
    reader = toxicity.Reader(np.full((toxicity.SIZE,) * 4, -3.0, np.float32), toxicity.Lexicon({"=idiot": 2.0}))
    assert len(reader.hits(text)) == toxicity.N_HITS
    assert toxicity.restore(text, reader.decoder) is not None


def plain_statistics(text):
    """The statistics of the classifier one by one, character by character and word by word."""
    data, kind = text.encode("utf-8", "surrogatepass"), []
    for c in data:
        ch = chr(c)
        if c >= 128:
            kind.append("tail" if c < 192 else "lead")
        elif ch in "abcdefghijklmnopqrstuvwxyz":
            kind.append("lower")
        elif ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            kind.append("upper")
        elif ch in "0123456789":
            kind.append("digit")
        elif ch == "\n":
            kind.append("newline")
        elif ch in " \t\r\x0b\x0c\x1c\x1d\x1e\x1f":
            kind.append("blank")
        else:
            kind.append("symbol" if ch in "#*$%&|<>=@^~_+\\" else "mark" if ch in ".,;:!?" else "bracket" if ch in "()[]{}\"'`" else "other")
    share = lambda x: kind.count(x)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.split()]
    unique, nw, nu = sorted(set(words)), max(1, len(words)), max(1, len(set(words)))
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    often = sorted((words.count(w) for w in unique), reverse=True) + [0, 0, 0]
    nl = max(1, len(lines))
    return [
        np.log(1 + len(data)), np.log(1 + len(words)), np.log(1 + len(lines)), *(share(c) / max(1, len(data)) for c in quality.CLASSES),
        (share("upper") + 1) / (share("lower") + share("lead") + 2), share("symbol") / nw, share("mark") / nw, data.count(b"!") / nw, data.count(b"|") / nw,
        mean, (sum((x - mean) ** 2 for x in lengths) / len(lengths)) ** 0.5, max(lengths),
        len(unique) / nw, len({w.lower().strip(b".,;:!?#*$%&|<>") for w in unique}) / nu, sum(words[i] == words[i - 1] for i in range(1, len(words))) / nw,
        often[0] / nw, sum(often[:3]) / nw, (len({(words[i - 1], words[i]) for i in range(1, len(words))}) + 1) / nw,
        1 - len(set(lines)) / nl, len(data) / nl,
        sum(len(w) > 1 and chr(w[-1]) in "#*$%&|<>!" for w in unique) / nu, sum(len(w) == 1 for w in unique) / nu, sum(w.isalpha() for w in unique) / nu,
    ]


@settings(max_examples=300, deadline=None)
@given(st.one_of(WORDS, st.text(max_size=120), st.lists(st.sampled_from(["Word", "word,", "a", "!!", "|", "x#", "\n", " ", "ü1"]), max_size=40).map(" ".join)))
def test_statistics_equal_plain_ones(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text))
