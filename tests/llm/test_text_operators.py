"""Operators on single texts, against regular expressions, libraries and brute force."""

import random
import re
import unicodedata

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakescribe.llm import pii, quality, secrets
from lakescribe.llm.automaton import combine_dfas, compile_dfa, rows_of
from lakescribe.llm.common import chunks, code_points
from lakescribe.llm.pieces import MARK, Pieces, read_model
from lakescribe.llm.queries import tokenizer_path
from lakescribe.llm.token_counts import PairMerger

BASE_SECRETS = {
    "assign": (re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.RULES, secrets._tables(secrets.RULES))


def base_secrets(text):
    return sorted((m.start(), i, m.end()) for i, (p, ok) in enumerate(BASE_SECRETS.values()) for m in p.finditer(text) if ok(m))


SECRET_PARTS = ["secret", "token", "password", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP",
                "0123456789abcdef", "ff", "-", "é", "PassWD", "=x", "\n"]


def test_base_secrets_are_those_of_the_patterns(scanner):
    rnd = random.Random(1)
    for _ in range(8_000):
        text = "".join(rnd.choice(SECRET_PARTS) for _ in range(rnd.randint(0, 14))).encode()
        assert [(s, r, e) for r, s, e in scanner.spans(text) if r < 3] == base_secrets(text), text


def test_added_secrets(scanner):
    shown = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "web_token": "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "forge_token": "ghp_" + "a1B2" * 9,
        "chat_token": "xoxb-1234567890-abcdef", "cloud_key": "AIza" + "Sy0-" * 9,
    }
    for kind, text in shown.items():
        found = {secrets.RULES[r].kind: (s, e) for r, s, e in scanner.spans(f"é {text} ".encode())}
        assert found[kind] == (3, 3 + len(text))
    assert not scanner.spans(b"ghp_short AIzaShort xoxb-1 eyJ.eyJ.x -----BEGIN KEY-----")


def test_private_keys_go_with_their_bodies(scanner):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = ["MIIE" + "aB3+/" * 12, "Zz09" * 16, "Q0FrZXk=="]
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0123AB\n\n"
    for gap in ("\n", "\r\n", "\\n", " ", "\n    "):
        for key in (gap.join([begin, *lines, end]), gap.join([begin, *lines]), gap.join([begin, "short", end]), f"{begin}\n{fields}{gap.join([*lines, end])}"):
            assert secrets._redacted(scanner, f"é {key}\n-- and more, {key}.".encode(), "[secret]") == "é [secret]\n-- and more, [secret].", key
    assert secrets._redacted(scanner, f"{begin} is how it begins".encode(), "[secret]") == "[secret] is how it begins"
    assert secrets._redacted(scanner, f"{begin}\nsome words".encode(), "[secret]") == "[secret]\nsome words"
    hard = f"{begin} X: " * 6_000
    assert len(scanner.spans(hard.encode())) == 6_000


def test_scan_is_linear_in_hard_texts(scanner):
    assert scanner.spans(b"secret=token:" + b"A" * 300_000) == []  # the dropped match has taken the second word
    assert scanner.spans(b"f" * 300_000) == [(2, 0, 300_000)]


def test_automaton_is_minimal_and_rejects_what_it_does_not_know():
    table, accept = compile_dfa("(ab|cb)+")
    assert len(table) == 4 and accept.sum() == 1  # start, after a or c, accepting, dead
    row = rows_of(*combine_dfas([(table, accept)]))
    for byte in b"xxab":
        row = row[byte]
    assert row[256] == 1
    with pytest.raises(ValueError):
        compile_dfa("^a")
    with pytest.raises(ValueError):
        compile_dfa("é")


# --- personal data --------------------------------------------------------------------------------

BASE_PII = {
    "email": rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": rb"[0-9]([\x20-]?[0-9])+", "phone": rb"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_hand_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_pii(text):
    digits = lambda m: re.sub(rb"[^0-9]", b"", m[0])
    holds = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(b".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and by_hand_luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return sorted((m.start(), i, m.end()) for i, k in enumerate(pii.BASE) for m in re.finditer(BASE_PII[k], text) if holds[k](m))


PII_PARTS = ["a", "b.c", "@", "@x", "..", ".", "+", "%", "1", "22", "333", ".4", "-", " ", "(", ")", "4111111111111111", "4111 1111-1111 1111",
             "+49 30 1234567", "256", "é", "\n", "1.2.3.4", "0001"]


def test_base_personal_data_is_that_of_the_patterns():
    rnd = random.Random(2)
    for _ in range(8_000):
        text = "".join(rnd.choice(PII_PARTS) for _ in range(rnd.randint(0, 16))).encode()
        assert [(s, pii.KINDS.index(k), e) for k, s, e, _ in pii.find(text) if k in pii.BASE] == base_pii(text), text


def test_checksums_and_context():
    found = {k: score for k, _, _, score in pii.find(b"my iban: GB82 WEST 1234 5698 7654 32, mail me at a@b.de; ssn 123-45-6789")}
    assert found["iban"] == 1.0 and found["email"] == 1.0 and found["ssn"] == 0.6
    assert "ssn" not in {k for k, *_ in pii.find(b"number 123-45-6789")}  # nothing near speaks for it
    assert not pii.find(b"GB83WEST12345698765432")
    assert pii.luhn(b"4111111111111111") and not pii.luhn(b"4111111111111112")


def test_accounts_end_before_what_follows_them():
    account, other = b"GB82 WEST 1234 5698 7654 32", b"DE89370400440532013000"
    for text in (account + b" BIC NWBKGB2L", account + b" 2024-01-05", account + b"\n", account + b" and", account):
        assert (text[:0] + account, "iban") in [(text[s:e], k) for k, s, e, _ in pii.find(text)], text
    for text in (other + b" EUR 50", b"AB12 " + other, other + b" " + account, b"XX00 1234 5678 9012 345 " + other):
        assert other in [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"], text
    both = other + b" " + account
    assert [both[s:e] for k, s, e, _ in pii.find(both) if k == "iban"] == [other, account]
    for text in (account + b"a", account + b"X", b"a" + account, b"GB82 WEST 1234"):
        assert "iban" not in {k for k, *_ in pii.find(text)}, text


def test_personal_data_in_hard_texts():
    for text in (b"a" * 200_000, b"1" * 200_000, b"1." * 100_000, b"@a." * 70_000, b"+1 " + b"(" * 200_000, b"AB12" * 50_000):
        pii.find(text)


# --- quality --------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#*é"), max_size=60))
def test_base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    assert quality.base_counts(text.encode()) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    m = (p + q[2]) / 2
    by_hand = np.sqrt((sum(a * np.log2(a / b) for a, b in zip(p, m) if a) + sum(a * np.log2(a / b) for a, b in zip(q[2], m) if a)) / 2)
    assert np.allclose(quality.js_distance(p, q), [0, 1, by_hand])


def test_short_texts_have_no_distance():
    counts = np.ones(quality.N_CLASSES + quality.N_WORDS)
    judge = quality.Judge({"en": counts}, quality.Limits())
    assert judge.distances(b"too short") == (None, None)
    assert judge.distances(b"$ " * 300)[0] > 0.28
    assert quality.Judge({}, quality.Limits()).row(b"word " * 60)[6] is False  # repeats alone make it fail


# --- tokens and pieces ----------------------------------------------------------------------------

WORD_PARTS = ["aaaa", "aaa", "Ab", "é", unicodedata.normalize("NFD", "é"), "ΑΣ", "İ", "<|endoftext|>", "<|startoftext|>", "<|END", "'s", "'LL",
              "12", "½", "日本", " ", "\x1c", "​", "!!", "--", "\n", "\t", "don't", "ß", "ﬁ", "😀", "\x85", "ǅ"]


def test_token_counts_are_those_of_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    merger, library, rnd = PairMerger(path), Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(rnd.choice(WORD_PARTS) for _ in range(rnd.randint(0, 12))) for _ in range(4_000)]
    texts += ["".join(rnd.choice("abcdefghij") for _ in range(5_000)), "a" * 100_000, ""]
    assert merger.counts(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    merger.together = False  # pair by pair gives the same
    merger.known.clear()
    assert merger.counts(texts[:500]) == [len(x.ids) for x in library.encode_batch(texts[:500], add_special_tokens=False)]


@pytest.fixture(scope="module")
def model():
    return Pieces(tokenizer_path("piece_bpe_32k.model"))


def best_score(model, data):
    """Over all segmentations, piece by piece from a dictionary."""
    pieces = {p: s for p, s, k in read_model(tokenizer_path("piece_bpe_32k.model"))[0] if k == 1}
    longest, best = max(map(len, pieces)), {0: 0.0}
    ends = [i for i in range(len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
    for i, j in ((i, j) for j in ends for i in ends if i < j and j - i <= longest):
        single = not any(i < k < j for k in ends)
        score = pieces.get(data[i:j], model.unknown if single else None)
        if score is not None and i in best:
            best[j] = max(best.get(j, float("-inf")), best[i] + score)
    return best[len(data)]


PIECE_PARTS = ["the", "Hello", " ", "  ", "\n", "\t", "é", "日本", "😀", "foo", "ing", "   ", "qqq", "ź", "and", "of"]


def test_viterbi_is_the_best_segmentation_and_decodes(model):
    rnd = random.Random(4)
    for _ in range(250):
        text = "".join(rnd.choice(PIECE_PARTS) for _ in range(rnd.randint(1, 7)))
        data = MARK + text.encode().replace(b" ", MARK)
        ids = model.encode(text.encode())
        assert list(ids) == list(model.viterbi(data))  # word by word is the same as all at once
        fallback = {v: k for k, v in model.byte_id.items()}
        score, shown = 0.0, b""
        for i in ids:
            shown += bytes([fallback[i]]) if i in fallback else b""
            score += 0.0 if i in fallback else model.scores[i]
        score += model.unknown * len(shown.decode())
        assert score == pytest.approx(best_score(model, data))
        assert model.decode(ids) == text.encode()


def test_pieces_are_those_of_the_library_as_a_unigram_model(model):
    raw = open(tokenizer_path("piece_bpe_32k.model"), "rb").read()
    at = raw.index(b"\x18\x02 \x80\xfa\x01")  # the trainer's model type
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x18\x01" + raw[at + 2 :])
    for text in ("the", "then", "with", "reand", "hello and the thing", "Released under the license", "of this and that"):
        assert list(model.encode(text.encode())) == library.nbest_encode(text, nbest_size=2)[0]  # by the exact lattice


def test_empty_and_marker(model):
    assert list(model.encode(b"")) == [] and model.decode([]) == b""
    assert model.decode(model.encode("a▁b".encode())) == b"a b"  # the one text that does not come back


def test_chunks_and_code_points():
    assert list(chunks([b"aa", b"b" * 9, b"", b"c"], 4)) == [(0, 1), (1, 2), (2, 4)] and list(chunks([])) == []
    assert code_points("aé😀b".encode(), [0, 1, 3, 7, 8]) == {0: 0, 1: 1, 3: 2, 7: 3, 8: 4}
