"""Field normalisers: each adds its columns to a DataFrame of source rows and drops no row.

Every normaliser leaves a value (null if unusable), its confidence and the codes of its issues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed
from sievework.functions.similarity import first_near
from sievework.functions.text import add_clean, clean, key, slug, strip_accents
from sievework.operators.suffixes import add_domains


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _codes(*pairs: tuple[Column, str]) -> Column:
    # no filter of an array: its function is interpreted for each row, and all the conditions with it
    return F.concat(*[F.when(cond, F.array(F.lit(code))).otherwise(F.array().cast("array<string>")) for cond, code in pairs])


def email_syntax(raw: Column) -> Column:
    """Lower case, no spaces, no punctuation around it; null if it is no address."""
    return _address(_bare_email(clean(raw)))


def _bare_email(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", ""), F.lit(".,;:<>()[]\"'"))


def _address(e: Column) -> Column:
    return F.when(e.rlike(fixed.EMAIL_PATTERN), e)


def lookalike_of(domain: Column, targets: list[str] = fixed.MAJORS, least: float = fixed.LOOKALIKE_RATIO) -> Column:
    """The first target domain this one resembles without being a free provider's, else null."""
    return F.when(~domain.isin(fixed.FREEMAIL), first_near(domain, targets, least))


def add_email(df: DataFrame) -> DataFrame:
    """email_value, _domain, _free, _role, _typo, _lookalike, _disposable, _confidence, _codes from ``email``.

    The resemblance of domains is worked out once for each distinct domain and joined back.
    """
    # staged in columns, like the other fields: what an expression uses twice it works out twice
    out = add_clean(df, "_c", F.col("email")).withColumn("_e", _bare_email(F.col("_c"))).withColumn("_e", _address(F.col("_e")))
    out = out.withColumn("_d", F.split_part("_e", F.lit("@"), F.lit(2))).withColumn("email_typo", F.coalesce(F.map_contains_key(_map(fixed.TYPOS), F.col("_d")), F.lit(False)))
    out = out.withColumn("email_domain", F.coalesce(F.try_element_at(_map(fixed.TYPOS), F.col("_d")), F.col("_d")))
    # conditions hang on the count, as Spark pushes others below the grouping and repeats the stages in them; corrected domains are told apart after
    near = out.groupBy("email_domain").agg(F.count("*").alias("_n")).withColumn("_near", lookalike_of(F.when(F.col("_n") > 0, F.col("email_domain")))).where("_near is not null").drop("_n")
    out = out.join(near.withColumnRenamed("email_domain", "_dom"), F.col("email_domain") == F.col("_dom"), "left").drop("_dom")
    local = F.split_part(F.col("_e"), F.lit("@"), F.lit(1))
    d = F.col("email_domain")
    known = d.isNotNull()
    out = (
        out.withColumn("email_value", F.concat(local, F.lit("@"), d)).withColumn("email_free", F.coalesce(d.isin(fixed.FREEMAIL), F.lit(False)))
        .withColumn("email_role", F.coalesce(F.split_part(local, F.lit("+"), F.lit(1)).isin(fixed.ROLES), F.lit(False)))
        .withColumn("email_disposable", F.coalesce(d.isin(fixed.DISPOSABLE), F.lit(False)))
        .withColumn("email_lookalike", known & ~F.col("email_typo") & F.col("_near").isNotNull())
    )
    confidence = F.when(F.col("email_typo"), 0.75).when(F.col("email_lookalike"), 0.6).otherwise(1.0)
    confidence = F.when(known, F.when(F.col("email_disposable"), F.least(confidence, F.lit(0.2))).otherwise(confidence)).otherwise(0.0)
    codes = _codes((F.col("_c").isNotNull() & ~known, "email_invalid_syntax"), (F.col("email_typo"), "email_typo_domain_corrected"), (F.col("email_lookalike"), "email_domain_lookalike"), (F.col("email_disposable"), "email_disposable_domain"))
    return out.withColumn("email_confidence", confidence.cast("double")).withColumn("email_codes", codes).drop("_c", "_e", "_d", "_near")


def _phone_tables(rules: list[tuple]) -> dict[int, Column]:
    """Prefix (calling code and leading digits) to what its region does, a table for each length, longest first: a lookup compares with every key of its table."""
    by_prefix = {code + lead: (code, region, [int(n) for n in lengths.split()], fixed_line, mobile, trunk) for code, leads, region, lengths, fixed_line, mobile, trunk, _ in rules for lead in (leads.split() or [""])}
    quoted = lambda x: "array(" + ", ".join(map(str, x)) + ")" if isinstance(x, list) else f"'{x}'"
    struct = lambda r: "named_struct(" + ", ".join(f"'{n}', {quoted(x)}" for n, x in zip(("code", "region", "lengths", "fixed", "mobile", "trunk"), r)) + ")"
    # one expression each, since thousands of small ones take seconds to make
    return {size: F.expr("map(" + ", ".join(f"'{k}', {struct(r)}" for k, r in by_prefix.items() if len(k) == size) + ")") for size in sorted({len(k) for k in by_prefix}, reverse=True)}


def add_phone(df: DataFrame, field: str = "phone", rules: list[tuple] = fixed.PHONE_RULES, region: str = "IN") -> DataFrame:
    """``field``_value (E.164), _region, _national, _type, _mobile, _confidence, _codes.

    ``rules`` is a table like ``fixed.PHONE_RULES``, small as a policy file; the longest prefix of calling
    code and leading digits that a number begins with names its region. A number that begins with
    neither + nor 00 is one of ``region``, unless only leaving that region's calling code away gives it
    a length of the region. A trunk prefix goes where the number is of a right length without it, an
    extension always. Numbers of a length that their region does not have are impossible (null);
    numbers outside of its ranges, and of regions without rules, are kept with confidence 0.5. type is
    mobile, fixed_line, fixed_line_or_mobile (where a region does not tell them apart) or unknown; the
    first and the third are mobile.

    A condition on one of these columns that Spark can push below them repeats their derivation until
    planning no longer ends; put it behind a grouping's count or a written table, as the ingest does.
    """
    tables = _phone_tables(rules)
    home = next((r for r in rules if r[2] == region), None)
    if home is None:
        raise ValueError(f"no rule of region {region}")
    home_code, home_lengths = home[0], [int(n) for n in home[3].split()]
    # staged in columns, each used many times after: an expression built of the whole would repeat them all
    out = add_clean(df, "_raw", F.col(field)).withColumn("_text", F.regexp_replace("_raw", r"(?i)[\s,;]*(ext\.?|extn\.?|x|#)\s*[0-9]{1,7}$", ""))
    out = out.withColumn("_plus", F.regexp_replace(F.regexp_replace("_text", r"[^0-9+]", ""), r"^00", "+")).withColumn("_bare", F.regexp_replace("_plus", r"\+", ""))
    bare, code_length = F.col("_bare"), len(home_code)
    coded = bare.startswith(home_code) & (F.length(bare) - code_length).isin(home_lengths) & ~F.length(bare).isin(home_lengths)
    abroad = F.col("_plus").startswith("+")
    out = out.withColumn("_full", F.when(abroad | coded, bare).otherwise(F.concat(F.lit(home_code), bare)))
    ruled = lambda c: F.coalesce(*[F.try_element_at(table, F.substring(c, 1, k)) for k, table in tables.items()])
    out = out.withColumn("_rule", ruled(F.col("_full")))
    rule = F.col("_rule")
    out = out.withColumn("_rest", F.coalesce(F.substr("_full", F.length(rule.code) + 1), F.col("_full")))
    rest = F.col("_rest")
    bare_trunk = F.substr(rest, F.length(rule.trunk) + 1)
    has = F.coalesce(rest.startswith(rule.trunk) & (rule.trunk != ""), F.lit(False))
    fits = lambda c: F.coalesce(F.array_contains(rule.lengths, F.length(c)), F.lit(False))
    falls = lambda c: F.coalesce(F.regexp_like(c, F.concat(F.lit("^("), rule.fixed, F.lit("|"), rule.mobile, F.lit(")$"))), F.lit(False))
    out = out.withColumn("_national", F.when(has & (falls(bare_trunk) | (fits(bare_trunk) & ~falls(rest))), bare_trunk).otherwise(rest))
    national = F.col("_national")
    out = out.withColumn("_rule", F.when(national != rest, F.coalesce(ruled(F.concat(rule.code, national)), rule)).otherwise(rule))  # leading digits may stand behind the trunk prefix
    whole = lambda p: F.coalesce(F.regexp_like(national, F.concat(F.lit("^("), p, F.lit(")$"))), F.lit(False))
    out = out.withColumn("_readable", F.coalesce(F.col("_raw").isNotNull() & (F.length(bare) > 0) & ~F.col("_text").rlike("[A-Za-z]{3,}"), F.lit(False)))
    out = out.withColumn("_possible", F.when(rule.isNull(), F.length(national).between(*fixed.PHONE_LENGTHS)).otherwise(fits(national)))
    out = out.withColumn("_ok", F.coalesce(F.col("_readable") & F.col("_possible"), F.lit(False))).withColumn("_fixed", whole(rule.fixed)).withColumn("_mobile", whole(rule.mobile))
    ok, is_fixed, is_mobile, readable = F.col("_ok"), F.col("_fixed"), F.col("_mobile"), F.col("_readable")
    kind = F.when(is_fixed & is_mobile, "fixed_line_or_mobile").when(is_mobile, "mobile").when(is_fixed, "fixed_line").otherwise("unknown")
    valid = is_fixed | is_mobile
    return (
        out.withColumn(f"{field}_value", F.when(ok, F.concat(F.lit("+"), F.coalesce(rule.code, F.lit("")), national))).withColumn(f"{field}_region", F.when(ok, rule.region)).withColumn(f"{field}_national", F.when(ok, national))
        .withColumn(f"{field}_type", F.when(ok, kind)).withColumn(f"{field}_mobile", ok & is_mobile).withColumn(f"{field}_confidence", F.when(ok, F.when(valid, 1.0).otherwise(0.5)).otherwise(0.0).cast("double"))
        .withColumn(f"{field}_codes", _codes((F.col("_raw").isNotNull() & ~readable, "phone_unparseable"), (readable & ~ok, "phone_impossible"), (ok & ~valid, "phone_invalid")))
        .drop("_raw", "_text", "_plus", "_bare", "_full", "_rule", "_rest", "_national", "_readable", "_possible", "_ok", "_fixed", "_mobile")
    )


def registrable_domain(host: Column, suffixes: list[str] = fixed.SUFFIXES) -> Column:
    """The label before the longest known public suffix, with it; null for a bare suffix."""
    two = F.substring_index(host, ".", -2)  # the host itself if it has no more labels
    known = two.isin(suffixes)
    return F.when(host.isNull() | ~F.contains(host, F.lit(".")), None).when(known & (two == host), None).when(known, F.substring_index(host, ".", -3)).otherwise(two)


def strip_tracking(query: Column) -> Column:
    return F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).rlike(fixed.TRACKING_PATTERN)), "&")


def host_class(host: Column, registrable: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, hosts in reversed(list(fixed.HOST_CLASSES.items())):
        out = F.when(host.isin(hosts) | F.coalesce(registrable.isin(hosts), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def add_url(df: DataFrame, field: str = "website", kind: str = "website", rules: DataFrame | None = None) -> DataFrame:
    """``field``_value, _host, _domain, _class, _owned, _handle, _numeric, _confidence, _codes.

    The domain is the registrable one, or the host where there is none: by ``rules`` (a table of public
    suffix rules, see ``suffixes``), which are joined, or else by the short list of fixed suffixes.
    """
    out = add_clean(df, "_raw", F.col(field))
    out = out.withColumn("_rest", F.regexp_replace("_raw", r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""))
    host = F.lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1))
    for pattern in (r"^.*@", r":\d*$", r"\.$", r"^www\."):  # user, port, trailing dot, www
        host = F.regexp_replace(host, pattern, "")
    out = out.withColumn("_host", host).withColumn("_path", F.regexp_replace(F.regexp_replace(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), r"/{2,}", "/"), r"/+$", ""))
    out = out.withColumn("_query", F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)).withColumn("_query", F.when(F.col("_query") == "", "").otherwise(strip_tracking(F.col("_query"))))
    raw, path, query = F.col("_raw"), F.col("_path"), F.col("_query")
    ok = F.coalesce(raw.isNotNull() & F.contains("_host", F.lit(".")), F.lit(False))
    value = F.concat(F.lit("https://"), F.col("_host"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    out = out.withColumn(f"{field}_value", F.when(ok, value)).withColumn(f"{field}_host", F.when(ok, F.col("_host")))
    if rules is None:
        out = out.withColumn(f"{field}_domain", registrable_domain(F.col(f"{field}_host")))
    else:
        out = add_domains(out, f"{field}_host", rules, f"{field}_domain", "_suffix").drop("_suffix")
    out = out.withColumn(f"{field}_domain", F.coalesce(f"{field}_domain", f"{field}_host"))
    klass = host_class(F.col(f"{field}_host"), F.col(f"{field}_domain"))
    handle = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(path, p, 1)), F.lit("")) for p in fixed.HANDLE_PATTERNS.get(kind, [])], F.lit(None).cast("string"))
    out = out.withColumn(f"{field}_class", klass).withColumn(f"{field}_owned", F.col(f"{field}_host").isNotNull() & F.col(f"{field}_class").isNull())
    out = out.withColumn(f"{field}_handle", F.when(ok, handle)).withColumn(f"{field}_numeric", F.coalesce(F.col(f"{field}_handle").rlike(r"^\d{8,}$"), F.lit(False)))
    missing = raw.isNotNull() & ~ok
    codes = [(missing, "url_missing_host")]
    if kind == "website":
        codes += [(F.col(f"{field}_class") == c, f"website_not_owned_{c}") for c in fixed.HOST_CLASSES]
    else:
        codes.append((F.col(f"{field}_numeric"), "profile_numeric_id_only"))
    confidence = F.when(~ok | raw.isNull(), 0.0).when(F.col(f"{field}_class").isNotNull() if kind == "website" else F.lit(False), 0.4).otherwise(1.0)
    return out.withColumn(f"{field}_confidence", confidence.cast("double")).withColumn(f"{field}_codes", _codes(*codes)).drop("_raw", "_rest", "_host", "_path", "_query")


def add_followers(df: DataFrame) -> DataFrame:
    """followers_value, _exact, _confidence, _log, _codes from ``followers`` ("1,234", "1.4K", "12M")."""
    out = add_clean(df, "_raw", F.col("followers")).withColumn("_t", F.upper(F.regexp_replace("_raw", r"[, ]", "")))
    raw, t = F.col("_raw"), F.col("_t")
    out = out.withColumn("_shaped", t.rlike(r"^-?\d+(\.\d+)?[KMB]?$")).withColumn("_unit", F.regexp_extract(t, r"([KMB])$", 1))
    shaped, unit = F.col("_shaped"), F.col("_unit")
    out = out.withColumn("_number", F.regexp_extract(t, r"^(-?\d+(\.\d+)?)", 1).try_cast("double") * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0))
    number = F.col("_number")
    # a plain fraction is cut, one with a unit rounded to even
    out = out.withColumn("_whole", F.when(unit == "", F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).otherwise(F.bround(number, 0)).cast("long"))
    negative = shaped & (F.col("_whole") < 0)
    value = F.col("followers_value")
    return (
        out.withColumn("followers_value", F.when(shaped & ~negative, F.col("_whole"))).withColumn("followers_exact", F.coalesce(value.isNotNull() & (unit == ""), F.lit(False)))
        .withColumn("followers_confidence", F.when(value.isNull(), 0.0).when(unit != "", 0.85).otherwise(1.0).cast("double")).withColumn("followers_log", F.bround(F.log1p(value.cast("double")), 6))
        .withColumn("followers_codes", _codes((raw.isNotNull() & ~shaped, "followers_unparseable"), (negative, "followers_negative"), (value > fixed.FOLLOWERS_CEILING, "followers_implausible")))
        .drop("_raw", "_t", "_shaped", "_unit", "_number", "_whole")
    )


def add_name(df: DataFrame, fold=strip_accents) -> DataFrame:
    """name_display, name_value, _placeholder, _kind, _confidence, _codes from ``name``.

    ``fold`` takes accents off: ``text.nfkd`` covers all of Unicode in Arrow batches, the default
    stays in the JVM and covers Latin accents.
    """
    out = add_clean(df, "_whole", F.col("name")).withColumn("_whole", F.trim(F.regexp_replace("_whole", r"\s+", " ")))
    whole = F.col("_whole")
    out = out.withColumn("name_display", F.substring(whole, 1, fixed.NAME_LENGTH))
    out = out.withColumn("_f", F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold(F.col("name_display"))), r"(?U)[^\w\s]", " "), r"\s+", " ")))
    bare = F.col("_f")
    for s in reversed(fixed.LEGAL_SUFFIXES):  # the first one in order that fits wins, so it is the outermost test
        bare = F.when(F.col("_f").endswith(" " + s), F.trim(F.expr(f"left(_f, length(_f) - {len(s) + 1})"))).otherwise(bare)
    out = out.withColumn("_f", bare).withColumn("name_value", F.coalesce(F.nullif("_f", F.lit("")), F.lower("name_display"))).withColumn("_tokens", F.split("name_value", " "))
    tokens = F.col("_tokens")
    kind = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, fixed.BUSINESS_TOKENS))), "business").when(F.arrays_overlap(tokens, F.array(*map(F.lit, fixed.HONORIFICS))), "person").when(F.size(tokens) >= 4, "business").otherwise("unknown")
    placeholder = F.coalesce(F.col("name_display").rlike(fixed.PLACEHOLDER_PATTERN), F.lit(False))
    out = out.withColumn("name_placeholder", placeholder).withColumn("name_kind", F.when(F.col("name_value").isNotNull(), kind).otherwise("unknown"))
    return out.withColumn("name_confidence", F.when(F.col("name_value").isNull(), 0.0).when(F.col("name_placeholder"), 0.2).otherwise(1.0).cast("double")).withColumn("name_codes", _codes((F.col("name_placeholder"), "name_placeholder"), (F.length(whole) > fixed.NAME_LENGTH, "name_truncated"))).drop("_whole", "_f", "_tokens")


def add_city(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """location_slug, _name, _state, _confidence, _match, city_codes from ``city``.

    ``gazetteer`` has key, match (exact, alias, locality, state, fragment, non_place), slug, name and
    state, one row for each key. It is joined by key; Spark broadcasts it where its size allows.
    """
    raw = F.col("_c")
    g = gazetteer.select(F.col("key").alias("_key"), F.col("match").alias("_match"), F.col("slug").alias("_slug"), F.col("name").alias("_name"), F.col("state").alias("_state"))
    out = add_clean(df, "_c", F.col("city")).withColumn("_k", key(raw)).join(g, F.col("_k") == F.col("_key"), "left")
    place = F.col("_match").isin(list(fixed.PLACE_CONFIDENCE))
    return (
        out.withColumn("location_slug", F.when(place, F.col("_slug"))).withColumn("location_name", F.when(place, F.col("_name"))).withColumn("location_state", F.when(place, F.col("_state"))).withColumn("location_match", F.when(place, F.col("_match")))
        .withColumn("location_confidence", F.when(place, F.element_at(_map(fixed.PLACE_CONFIDENCE), F.col("_match"))).otherwise(0.0).cast("double"))
        .withColumn("city_codes", _codes((F.col("_match") == "fragment", "city_address_fragment"), (F.col("_match") == "non_place", "city_not_a_place"), (raw.isNotNull() & F.col("_match").isNull(), "city_unresolved"), (F.col("_match") == "state", "city_resolved_to_state_only")))
        .drop("_c", "_k", "_key", "_match", "_slug", "_name", "_state")
    )


def add_category(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """category_slug, _confidence, _codes from ``fb_category`` (0.9), then ``niche`` (0.8).

    ``taxonomy`` has alias (a folded key) and slug, one row for each alias.
    """
    t = lambda p: taxonomy.select(F.col("alias").alias(f"_{p}a"), F.col("slug").alias(f"_{p}s"))
    fb, niche = F.col("_fc"), F.col("_nc")
    out = add_clean(add_clean(df, "_fc", F.col("fb_category")), "_nc", F.col("niche")).withColumn("_fk", key(fb)).withColumn("_nk", key(niche)).join(t("f"), F.col("_fk") == F.col("_fa"), "left").join(t("n"), F.col("_nk") == F.col("_na"), "left")
    real = lambda c: F.when(F.col(c) != fixed.UNCLASSIFIED, F.col(c))
    hit = F.coalesce(real("_fs"), real("_ns"))
    anything = fb.isNotNull() | niche.isNotNull()
    generic = (F.coalesce(F.col("_fs"), F.lit("")) == fixed.UNCLASSIFIED) | (F.coalesce(F.col("_ns"), F.lit("")) == fixed.UNCLASSIFIED)
    return (
        out.withColumn("category_slug", F.when(anything, F.coalesce(hit, F.lit(fixed.UNCLASSIFIED)))).withColumn("category_confidence", F.when(real("_fs").isNotNull(), 0.9).when(real("_ns").isNotNull(), 0.8).otherwise(0.0).cast("double"))
        .withColumn("category_codes", _codes((anything & hit.isNull() & generic, "category_generic"), (anything & hit.isNull() & ~generic, "category_unmapped"))).drop("_fc", "_nc", "_fk", "_nk", "_fa", "_fs", "_na", "_ns")
    )


def _carrying(df: DataFrame, fields: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``add`` over the columns ``fields``, all others carried beside them as one: each stage of a normaliser copies its rows, one column after another."""
    rest = [c for c in df.columns if c not in fields]
    out = add(df.select(F.struct(*rest).alias("_carried"), *fields))
    return out.select(*[c if c in fields else F.col(f"_carried.{c}") for c in df.columns], *[c for c in out.columns if c not in ("_carried", *fields)])


def normalize_rows(rows: DataFrame, gazetteer: DataFrame, taxonomy: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """All normalisers over source rows; ``field_codes`` has every issue (field, code), field by field.

    ``cut`` may write the rows between the fields: planning and compiling cost grows faster than the
    number of derived columns, so three narrow plans take a fraction of one wide one.
    """
    names = ["name", "city", "fb_category", "niche", "followers"]
    out = cut(_carrying(rows, names, lambda df: add_followers(add_category(add_city(add_name(df), gazetteer), taxonomy))), "normalized-names")
    out = cut(_carrying(out, ["email", "phone"], lambda df: add_phone(add_email(df))), "normalized-contacts")
    out = _carrying(out, ["website", "facebook"], lambda df: add_url(add_url(df, "website"), "facebook", "facebook"))
    out = out.withColumn("display_name", F.coalesce("name_display", F.concat(F.lit("(unnamed "), "batch", F.lit("#"), F.col("row_no").cast("string"), F.lit(")"))))
    out = out.withColumn("normalized_name", F.coalesce("name_value", F.lower("display_name"))).withColumn("company_domain", F.when(F.col("website_owned"), F.col("website_domain")))
    pairs = [("name", "name_codes"), ("city", "city_codes"), ("category", "category_codes"), ("followers", "followers_codes"), ("email", "email_codes"), ("phone", "phone_codes"), ("website", "website_codes"), ("facebook", "facebook_codes")]

    def named(f: str, c: str) -> Column:  # a function of each element would be interpreted
        return F.arrays_zip(F.array_repeat(F.lit(f), F.size(c)), c).cast("array<struct<field:string,code:string>>")

    each = [named(f, c) for f, c in pairs]
    return out.withColumn("field_codes", F.concat(*each)).drop(*[c for _, c in pairs])
