import random
import re

from gridloom.llm import pii
from gridloom.llm.queries import QUERIES
from tests.llm.helpers import awkward, documents, rows, sha, write


def brute(text):
    """The base spans by plain regular expressions."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def generated(n, seed=1):
    r = random.Random(seed)
    bits = ["a@b.co", "x.y@", "@", "mail me@site.example.org.", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1", "1.2.3.4@5.6", " ", "é", "\n", "-", "99", ".", "DE89 3704 0044 0532 0130 00",
            "ssn 078-05-1120", "a..b@-.-", "+123456789012345678"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(n)]


def test_base_against_brute_force(spark, tmp_path):
    texts = generated(400)
    docs = documents(spark, [*enumerate(texts, 100), *awkward()])
    got = rows(QUERIES["op10_pii"](spark, write(docs, tmp_path)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for i, t in [*enumerate(texts, 100), *awkward()]:
        b = brute(t)
        want.append((i, *(sum(k == x[0] for x in b) for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{s}:{e}" for k, s, e in b))))
    assert got == sorted(want, key=repr)


def test_added_kinds_and_scores():
    spans = pii.spans_of("my bank account is DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 33, ssn 078-05-1120")
    kinds = [(k, base) for k, _, _, _, base in spans]
    assert ("iban", False) in kinds and sum(k == "iban" for k, _ in kinds) == 1  # the second fails its check
    assert ("national_id", False) in kinds
    assert not pii.spans_of("order no 078-05-1120")
    near = pii.spans_of("call +44 20 7946 0958")[0]
    far = pii.spans_of("version +44 20 7946 0958")[0]
    assert near[3] > far[3] and near[4] and far[4]


def test_linear_on_long_texts():
    for bad in ("a" * 300000, "1" * 300000, "1." * 100000, "+1" * 100000, "a@" * 100000, "1 " * 150000, "+1" + "(" * 200000):
        pii.spans_of(bad)


def test_redact(spark):
    docs = documents(spark, ["write to a@b.org or +44 20 7946 0958 now", None, "clean"])
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out == {0: "write to [EMAIL] or [PHONE] now", 1: None, 2: "clean"}
    assert pii.redact(docs.limit(0)).columns == docs.columns
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_redact_leaves_no_base_span(spark):
    """Whatever the words nearby say: a doubt word, a doubt word inside a neighbour, a span that shows once another is gone."""
    texts = [
        "ann@mail7.example.com The of, onrely +1 (068) 555-2748", "version 10.0.0.1, example +44 20 7946 0958",
        "1.2.3.4 4111 1111 1111 1111 ", "order no 078-05-1120", *generated(400, 2),
    ]
    docs = documents(spark, [*enumerate(texts, 100), *awkward()])
    out = {r.doc_id: r.text for r in pii.redact(docs).where("doc_id >= 100").collect()}
    assert len(out) == len(texts) and not any(brute(t) for t in out.values())
    assert out[100] == "[EMAIL] The of, onrely [PHONE]" and out[101] == "version [IP], example [PHONE]"
    assert out[102] == "[IP] [CARD] " and out[103] == texts[3]


def test_words_inside_other_spans_are_no_context():
    for text in ("ann@mail7.example.com or +1 (068) 555-2748", "ann@mail7.other.com or +1 (068) 555-2748"):
        assert [(k, p) for k, _, _, p, _ in pii.spans_of(text)] == [("email", 0.9), ("phone", 0.6)]
    assert [k for k, *_ in pii.spans_of("ssn 078-05-1120 ann@example.org")] == ["email", "national_id"]
