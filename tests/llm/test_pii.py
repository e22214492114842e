import hashlib
import re

from filigree.llm.pii import pii_report

R = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base(x):
    out = []
    for r, (k, p) in enumerate(R.items()):
        for m in re.finditer(p, x):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda s=s: all(int(v) <= 255 for v in s.split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[k]()
            if ok:
                out.append((m.start(), r, k, m.end()))
    return sorted(out)


TEXTS = [
    "a@b.co+x@d.e and x.y%z@q-r.s.t. é a@b a@b.", "1.2.3.4.5.6.7.8 and 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111111111 5 4111 1111 1111 11116", "+1 (555) 010-7713 +12 +123456789012345678 +44 20 7946 0958. x+1 5550107713",
    "ñ" * 50 + "call +1 415 555 2671 or mail joe@ex.org; host 10.0.0.1; card 5500005555555559", "9" * 3000, "1 2 " * 3000, "a" * 4000 + "@", "a." * 2000 + "@x", "@" * 500, "+" * 500, "+1" + "-" * 500, "0.0.0.0" * 40, None, "", "x@y.z " * 700,
]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii_report(df).collect():
        want = base(TEXTS[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, _, k, _ in want) for n in R]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_added_kinds_need_a_check_or_context(spark):
    t = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "IBAN GB83 WEST 1234 5698 7654 32 bad", "social security 123-45-6789", "part 123-45-6789", "phone 415-555-2671 now", "part 415-555-2671"]
    got = [r.spans for r in pii_report(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:16:27", "", "phone_local:6:18", ""]


def test_rows_and_plan(docs, none):
    out = pii_report(docs)
    assert out.count() == docs.count() and pii_report(none).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_iban_ends_at_its_countrys_length(spark):
    t = ["DE89370400440532013000 Please pay", "DE89370400440532013000 BIC COBADEFF", "DE89 3704 0044 0532 0130 00 2024", "DE89370400440532013000", "DE893704004405320130001", "NO9386011117947 IN 2024"]
    got = [r.spans for r in pii_report(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["iban:0:22", "iban:0:22", "iban:0:27", "iban:0:22", "", "iban:0:15"]
