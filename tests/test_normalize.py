import pytest
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.functions import normalize as nz
from sievework.functions.similarity import indel_ratio, lcs, token_set_ratio
from sievework.functions.text import clean, nfkd, slug


def values(spark, fn, column, inputs, out):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {column} string")
    return [r[out] for r in fn(df).orderBy("i").collect()]


def test_clean(spark):
    df = spark.createDataFrame([(x,) for x in ["NaN", None, "", "   ", "inf", " a b "]], "x string")
    assert [r[0] for r in df.select(clean(F.col("x"))).collect()] == [None] * 5 + ["a b"]


def test_email(spark):
    given = ["  Hari@LiveLongWealth.IN ", "someone@gamil.com", "someone@gmaill.com", "info@gmail.com", "not-an-email", "<a.b@c.org>,", "x@mailinator.com", None]
    rows = nz.add_email(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, email string")).orderBy("i").collect()
    assert [r.email_value for r in rows] == ["hari@livelongwealth.in", "someone@gmail.com", "someone@gmaill.com", "info@gmail.com", None, "a.b@c.org", "x@mailinator.com", None]
    assert [r.email_codes for r in rows] == [[], ["email_typo_domain_corrected"], ["email_domain_lookalike"], [], ["email_invalid_syntax"], [], ["email_disposable_domain"], []]
    assert rows[3].email_free and rows[3].email_role and rows[1].email_confidence == 0.75 and rows[2].email_confidence == 0.6 and rows[6].email_confidence == 0.2


PHONES = [("+91 9010041297", "+919010041297", []), ("9010041297", "+919010041297", []), ("+91 12", None, ["phone_impossible"]), ("call me", None, ["phone_unparseable"]), ("+44 20 7946 0958", "+442079460958", []), ("+356 2100 1234", "+35621001234", ["phone_invalid"]), (None, None, [])]


def test_phone(spark):
    assert [(r.phone_value, r.phone_codes) for r in phones(spark, [x[0] for x in PHONES])] == [x[1:] for x in PHONES]


def test_url(spark):
    given = ["http://www.aashaayurveda.com/", "x.com/a?utm_source=q&id=7&fbclid=1#f", "http://www.bellsoverseas/", "linktr.ee/me", "HTTP://u@Shop.Example.co.uk:80//a//b/", None, "https://docs.google.com/forms"]
    rows = nz.add_url(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, website string")).orderBy("i").collect()
    assert [r.website_value for r in rows] == ["https://aashaayurveda.com", "https://x.com/a?id=7", None, "https://linktr.ee/me", "https://shop.example.co.uk/a/b", None, "https://docs.google.com/forms"]
    assert [r.website_class for r in rows] == [None, "social", None, "aggregator", None, None, "form"] and rows[4].website_domain == "example.co.uk"
    assert rows[2].website_codes == ["url_missing_host"] and [r.website_owned for r in rows] == [True, False, False, False, True, False, False]


@pytest.mark.parametrize("kind,url,handle,numeric", [("facebook", "https://facebook.com/61500000000001", "61500000000001", True), ("facebook", "https://www.facebook.com/pg/My.Page/about", "my.page", False), ("youtube", "https://youtube.com/@Chan", "chan", False), ("youtube", "https://youtube.com/channel/UCx", "ucx", False), ("linkedin", "https://linkedin.com/in/Some-One/", "some-one", False), ("instagram", "https://instagram.com/Abc/", "abc", False)])
def test_handles(spark, kind, url, handle, numeric):
    r = nz.add_url(spark.createDataFrame([(url,)], f"{kind} string"), kind, kind).first()
    assert (r[f"{kind}_handle"], r[f"{kind}_numeric"]) == (handle, numeric)


def test_followers(spark):
    given = ["3", "14", "1.4K", "173K", "12M", "0", "many", "-5", "1,234", None, "9B"]
    rows = nz.add_followers(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, followers string")).orderBy("i").collect()
    assert [r.followers_value for r in rows] == [3, 14, 1400, 173000, 12000000, 0, None, None, 1234, None, 9000000000]
    assert rows[6].followers_codes == ["followers_unparseable"] and rows[7].followers_codes == ["followers_negative"] and rows[10].followers_codes == ["followers_implausible"] and not rows[2].followers_exact


def test_name(spark):
    given = ["Acme Solutions Pvt Ltd", "Advertiser 13887200", "Dr. Ana Núñez", "José  &  Sons", "One Two Three Four", "Pvt Ltd", None, "Amulya Kamarapu", "a" * 600]
    rows = nz.add_name(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, name string")).orderBy("i").collect()
    assert [r.name_value for r in rows][:7] == ["acme solutions", "advertiser 13887200", "dr ana nunez", "jose sons", "one two three four", "pvt", None]
    assert [r.name_kind for r in rows] == ["business", "unknown", "person", "unknown", "business", "business", "unknown", "unknown", "unknown"]
    assert rows[1].name_placeholder and rows[1].name_confidence == 0.2 and rows[8].name_codes == ["name_truncated"] and len(rows[8].name_value) == 512


def test_city_and_category(spark):
    gaz = spark.createDataFrame([("mumbai", "exact", "mumbai", "Mumbai", "MH"), ("bengaluru", "alias", "bangalore", "Bangalore", "KA"), ("andheri", "locality", "mumbai", "Mumbai", "MH"), ("kerala", "state", "kerala", "Kerala", "Kerala"), ("road", "fragment", None, None, None), ("online", "non_place", None, None, None)], "key string, match string, slug string, name string, state string")
    given = ["Mumbai", " bengaluru ", "Andheri", "KERALA", "Road", "Online", "Nowhere", None]
    rows = nz.add_city(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, city string"), gaz).orderBy("i").collect()
    assert [(r.location_slug, r.location_confidence) for r in rows] == [("mumbai", 1.0), ("bangalore", 0.9), ("mumbai", 0.75), ("kerala", 0.5), (None, 0.0), (None, 0.0), (None, 0.0), (None, 0.0)]
    assert [r.city_codes for r in rows] == [[], [], [], ["city_resolved_to_state_only"], ["city_address_fragment"], ["city_not_a_place"], ["city_unresolved"], []]
    tax = spark.createDataFrame([("yoga", "wellness"), ("page", "unclassified")], "alias string, slug string")
    rows = nz.add_category(spark.createDataFrame([(0, "Yoga", None), (1, "Page", "yoga"), (2, "Page", None), (3, "zzz", None), (4, None, None)], "i int, fb_category string, niche string"), tax).orderBy("i").collect()
    assert [(r.category_slug, r.category_confidence, r.category_codes) for r in rows] == [("wellness", 0.9, []), ("wellness", 0.8, []), ("unclassified", 0.0, ["category_generic"]), ("unclassified", 0.0, ["category_unmapped"]), (None, 0.0, [])]


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarity(spark):
    pairs = [("gamil.com", "gmail.com"), ("gmaill.com", "gmail.com"), ("", "a"), ("abc", "abc"), ("kitten", "sitting"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select(lcs(F.col("a"), F.col("b")), indel_ratio(F.col("a"), F.col("b")))
    got = df.collect()
    assert [r[0] for r in got] == [plain_lcs(a, b) for a, b in pairs]
    assert [round(r[1], 1) for r in got][:2] == [88.9, 94.7] and got[-1][1] == 100
    r = spark.createDataFrame([("new york mets", "mets new york"), ("a b", "a b c"), ("x y", "z")], "a string, b string").select(token_set_ratio(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [100.0, 100.0, 0.0]


def test_unicode_folding(spark):
    df = spark.createDataFrame([("ﬁancé №5",), (None,)], "x string")
    assert [r[0] for r in df.select(nfkd("x")).collect()] == ["fiance No5", None]
    assert spark.range(1).select(slug(F.lit("São Paulo – East"))).first()[0] == "sao-paulo-east"


def phones(spark, raws, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, phone string")
    return [r for r in nz.add_phone(df, **options).orderBy("i").collect()]


def test_phone_of_every_region(spark):
    """Each region's example in five ways of writing it."""
    rules = fixed.PHONE_RULES
    assert len({r[2] for r in rules}) == len(rules) >= 50
    for write in ("+{c} {n}", "00{c}-{n}", "+{c}{n} ext. 12", "+{c} ({t}){n}", "+{c}.{n}x5"):
        for rule, r in zip(rules, phones(spark, [write.format(c=x[0], n=x[7], t=x[6]) for x in rules])):
            assert (r.phone_value, r.phone_region, r.phone_national, r.phone_mobile, r.phone_confidence, r.phone_codes) == (f"+{rule[0]}{rule[7]}", rule[2], rule[7], True, 1.0, []), (write, rule)


RANGES = [
    ("+12042345678", "+12042345678", "CA", "fixed_line_or_mobile"), ("+1 876 210 1234", "+18762101234", "JM", "fixed_line_or_mobile"), ("+1 212 012 3456", "+12120123456", "US", "unknown"), ("+7 701 123 45 67", "+77011234567", "KZ", "mobile"),
    ("+7 771 000 9998", "+77710009998", "KZ", "mobile"), ("+7 495 123-45-67", "+74951234567", "RU", "fixed_line"), ("+39 02 1234 5678", "+390212345678", "IT", "fixed_line"), ("+44 (0)20 7946 0018", "+442079460018", "GB", "fixed_line"), ("08123456789", "+918123456789", "IN", "mobile"),
    ("918123456789", "+918123456789", "IN", "mobile"), ("9123456789", "+919123456789", "IN", "mobile"), ("+91 1234567890", "+911234567890", "IN", "unknown"), ("+49 30 123456", "+4930123456", "DE", "fixed_line"), ("+999 1234567", "+9991234567", None, "unknown"), ("+44 12", None, None, None), ("+1 202 555 01234", None, None, None),
]


def test_phone_ranges(spark):
    for (raw, value, region, kind), r in zip(RANGES, phones(spark, [x[0] for x in RANGES])):
        assert (r.phone_value, r.phone_region, r.phone_type) == (value, region, kind), raw
        assert r.phone_codes == (["phone_impossible"] if value is None else ["phone_invalid"] if kind == "unknown" else [])


def test_phone_home_region_and_own_rules(spark):
    assert [r.phone_value for r in phones(spark, ["020 7946 0018", "2079460018", "442079460018", "+91 8123456789"], region="GB")] == ["+442079460018"] * 3 + ["+918123456789"]
    own = [("5", "", "XA", "4", "1[0-9]{3}", "2[0-9]{3}", "", "2000"), ("5", "21", "XB", "4", "", "21[0-9]{2}", "", "2100"), ("59", "", "XC", "3", "[0-9]{3}", "[0-9]{3}", "9", "123")]
    got = phones(spark, ["+52000", "+52100", "+5 1000", "+59123", "2001", "+59 9 123"], rules=own, region="XA")
    assert [(r.phone_region, r.phone_type) for r in got] == [("XA", "mobile"), ("XB", "mobile"), ("XA", "fixed_line"), ("XC", "fixed_line_or_mobile"), ("XA", "mobile"), ("XC", "fixed_line_or_mobile")]
    with pytest.raises(ValueError, match="no rule"):
        phones(spark, [], region="ZZ")


def test_urls_by_public_suffix_rules(spark):
    from sievework.operators.suffixes import rules_of

    df = spark.createDataFrame([(i, u) for i, u in enumerate(["https://shop.a.foo.ck/x", "www.ck", "http://b.co.uk", "https://co.uk", None, "http://m.facebook.com/x"])], "i int, website string")
    out = nz.add_url(df, rules=rules_of(spark, fixed.SUFFIX_RULES)).orderBy("i").collect()
    assert [r.website_domain for r in out] == ["a.foo.ck", None, "b.co.uk", "co.uk", None, "facebook.com"]  # without its www. the second has no dot
    assert out[5].website_class == "social" and out[0].website_owned and len(out) == 6


def test_each_text_is_trimmed_in_one_place(spark):
    from sievework.plans.store import plain_constraints

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    row = spark.createDataFrame([(" x ",) * 6], "name string, email string, phone string, website string, followers string, other string")
    for add, field in ((nz.add_name, "name"), (nz.add_email, "email"), (nz.add_phone, "phone"), (nz.add_url, "website"), (nz.add_followers, "followers")):
        with plain_constraints(spark):
            shown = plan(add(row.select(field, "other")).drop("other"))
        assert 1 <= shown.count(r"]+$") <= 1 + (field == "email"), field  # e-mail reads its rows once more for the distinct domains


def test_stages_of_a_normaliser_carry_other_columns_as_one(spark):
    from sievework.sources import batches

    sf, wide = "/root/testdata/sf0.001", {}

    def widths(p):
        own = [p.output().size()] if p.nodeName() == "Project" else []
        return own + [w for i in range(p.children().size()) for w in widths(p.children().apply(i))]

    def cut(df, name):
        out = spark.createDataFrame([], df.schema)
        plan = df._jdf.queryExecution().optimizedPlan()
        wide[name] = sum(w >= len(df.columns) - 5 for w in widths(plan))
        return out

    rows = nz.normalize_rows(spark.createDataFrame([], batches.source_rows(spark, sf).schema), batches.gazetteer(spark, sf), batches.taxonomy(spark), cut)
    assert set(wide) == {"normalized-names", "normalized-contacts"} and max(wide.values()) <= 1
    assert "_carried" not in rows.columns and rows.columns[:3] == ["batch", "batch_seq", "source_file"]


def test_normalisers_have_no_interpreted_functions_of_arrays(spark):
    # a filter or transform of an array is interpreted for each row, with the conditions in it
    from sievework.operators import resolve, rules

    text = spark.createDataFrame([], "row_id long, batch string, row_no int, name string, email string, phone string, followers string")
    fields = [nz.add_name, nz.add_email, nz.add_phone, nz.add_followers]
    rows = spark.createDataFrame([], "row_id long, lead_key long, name_value string, name_placeholder boolean, email_value string, email_confidence double, email_domain string, email_free boolean, email_role boolean, phone_value string, phone_confidence double, company_domain string, followers_value long, facebook_value string, facebook_numeric boolean, facebook_confidence double")
    for df in [*[f(text) for f in fields], rules.add_rule_codes(rows), resolve.identity_keys(rows), resolve.merge_identifiers(rows)]:
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_null_conditions_and_their_order(spark):
    from sievework.operators import rules

    schema = "name_value string, name_placeholder boolean, email_value string, email_domain string, email_free boolean, phone_value string, company_domain string, followers_value long, facebook_numeric boolean"
    rows = spark.createDataFrame([(None, True, None, None, None, None, None, None, True), ("a", None, "x@b.org", "b.org", None, None, "c.org", 0, None), ("a", False, "x@b.org", "b.org", False, None, "c.org", 0, None)], schema)
    got = [[tuple(x) for x in r.rule_codes] for r in rules.add_rule_codes(rows).collect()]
    assert got == [[("name", "no_name"), ("contact", "no_contact_channel"), ("record", "thin_record"), ("facebook", "unverifiable_identity")], [("followers", "zero_followers")], [("email", "email_domain_website_mismatch"), ("followers", "zero_followers")]]


def test_phone_prefixes_are_looked_up_by_length_and_behind_the_trunk(spark):
    assert list(nz._phone_tables(fixed.PHONE_RULES)) == [4, 3, 2, 1]
    assert values(spark, nz.add_phone, "phone", ["+1 1 416 555 0123", "+1 416 555 0123", "+1 1 201 555 0123"], "phone_region") == ["CA", "CA", "US"]
