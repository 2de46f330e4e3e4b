"""Indicators and labels of free text as column expressions: everything stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import net
from . import patterns as P

UNICODE, FOLDED = "(?U)", "(?iU)"


def _all(text: Column, pattern: str, flags: str = FOLDED) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(flags + P.AHEAD.get(pattern, "") + pattern), F.lit(0))
    need = P.NEEDED.get(pattern)
    return found if need is None else F.when(F.contains(text, F.lit(need)), found).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space that is cut from both ends of a value.
BLANK = " \t\n\r\x0b\x0c"


def _filled(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(BLANK))), lambda v: v != "")


def unique(values: Column) -> Column:
    """Trimmed, non-empty values, the first of each case-folded one, in order."""

    def first(rows: Column) -> Column:
        kept = F.filter(rows, lambda r, j: (j == 0) | (F.get(rows, j - 1)["k"] != r["k"]))
        return F.transform(F.array_sort(F.transform(kept, lambda r: F.struct(r["i"].alias("i"), r["v"].alias("v")))), lambda r: r["v"])

    keyed = F.transform(_filled(values), lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v")))
    return let(F.array_sort(keyed), first)


def unique_folded(values: Column) -> Column:
    """The same for values of one case."""
    return F.array_distinct(_filled(values))


def urls(text: Column) -> Column:
    return unique(F.transform(_all(text, P.URL), lambda u: F.regexp_replace(u, P.URL_TRAIL, "")))


def ips(text: Column) -> Column:
    return unique_folded(F.filter(_all(text, P.IPV4, UNICODE), lambda x: net.ip_number(x).isNotNull()))


def emails(text: Column) -> Column:
    return unique_folded(F.transform(_all(text, P.EMAIL, UNICODE), F.lower))


def hashes(text: Column) -> Column:
    return unique_folded(F.transform(_all(text, P.HASH, UNICODE), F.lower))


def cves(text: Column) -> Column:
    return unique_folded(F.transform(_all(text, P.CVE), F.upper))


def techniques(text: Column) -> Column:
    return unique_folded(F.transform(_all(text, P.TECHNIQUE), F.upper))


def actors(text: Column) -> Column:
    return unique_folded(F.transform(_all(text, P.ACTOR), F.upper))


def domains(text: Column, found_urls: Column | None = None, found_emails: Column | None = None) -> Column:
    """Hosts of URLs and bare domains; exact domains of e-mail addresses, file names and addresses are left out.

    The URLs and addresses of the text may be given where they are known.
    """
    known_urls, known_emails = urls(text) if found_urls is None else found_urls, emails(text) if found_emails is None else found_emails
    hosts = F.transform(known_urls, lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    found = F.array_distinct(F.transform(_all(text, P.DOMAIN, UNICODE), F.lower))

    def bare(both: Column) -> Column:
        def keep(d: Column) -> Column:
            suffix = F.lit(False)
            for s in P.FILE_SUFFIXES:
                suffix = suffix | d.endswith(s)
            return ~F.array_contains(both["mail"], d) & ~suffix & net.ip_number(d).isNull()

        return F.filter(both["found"], keep)

    mail = F.array_distinct(F.transform(known_emails, lambda e: F.substring_index(e, "@", -1)))
    return unique_folded(F.concat(hosts, let(F.struct(found.alias("found"), mail.alias("mail")), bare)))


EXTRACTORS: dict[str, Callable[[Column], Column]] = {"ips": ips, "domains": domains, "urls": urls, "emails": emails, "hashes": hashes, "cves": cves, "mitre_techniques": techniques, "threat_actors": actors}


def artifacts(text: Column, cap: int | None = 100) -> Column:
    """struct of the indicator lists, public and other addresses apart; at most `cap` of each, as the reports show, or all."""
    def every(t: Column) -> Column:
        first = F.struct(*[f(t).alias(k) for k, f in EXTRACTORS.items() if f is not domains])
        return let(first, lambda e: F.struct(e.alias("e"), domains(t, e["urls"], e["emails"]).alias("domains")))

    def split(h: Column) -> Column:
        e = h["e"]
        lists = {k: h[k] if k == "domains" else e[k] for k in EXTRACTORS} | {"public_ips": F.filter(e["ips"], net.is_public), "non_public_ips": F.filter(e["ips"], lambda x: ~net.is_public(x))}
        return F.struct(*[(v if cap is None else F.slice(v, 1, cap)).alias(k) for k, v in lists.items()])

    return let(let(text, every), split)


def for_context(found: Column) -> Column:
    """The lists that may stand for a document: of addresses only public ones."""
    return let(found, lambda f: F.struct(f["public_ips"].alias("ips"), *[f[k].alias(k) for k in EXTRACTORS if k != "ips"]))


def counts(found: Column) -> Column:
    return let(found, lambda f: F.struct(*[F.size(f[k]).alias(k) for k in EXTRACTORS]))


def ranked_labels(text: Column, families: dict[str, str], most: int) -> Column:
    """Names of the families that match, most matches first, then by name."""
    scored = F.array(*[F.struct((-F.regexp_count(F.coalesce(text, F.lit("")), F.lit(FOLDED + p))).alias("n"), F.lit(k).alias("label")) for k, p in families.items()])
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda s: s["n"] < 0)), 1, most), lambda s: s["label"])


def context_labels(text: Column, most: int = 4) -> Column:
    return ranked_labels(text, P.LABELS, most)


def behavior_tags(text: Column, most: int = 6) -> Column:
    return ranked_labels(text, P.BEHAVIORS, most)


def refang(text: Column) -> Column:
    """Disguised spellings undone; text without a bracket, an invisible mark or a disguised scheme is as it was."""
    given = F.coalesce(text, F.lit(""))
    plain = reduce(lambda x, swap: F.regexp_replace(x, FOLDED + swap[0], swap[1]), P.REFANG, given)
    marked = (F.translate(given, "[({\u200b\ufeff", "") != given) | F.contains(F.lower(given), F.lit("hxxp"))
    return F.when(marked, plain).otherwise(given)


def variants(value: str, most: int = 24) -> list[str]:
    """Defanged spellings of one indicator, itself and its plain form first, case-insensitively distinct.

    A spelling is a choice of scheme, of what stands for its colon, and of what stands for the dots; only one of the
    last two is disguised at a time, and dots only where the scheme is plain.
    """

    def spellings(plain: str) -> Iterator[str]:
        head, mark, tail = plain.partition("://")
        yield from (plain.replace(".", dot) for dot in P.DOTS if "." in plain)
        web = head.lower() in ("http", "https")
        for scheme in (head, "hxxp" + head[4:]) if mark else ():
            if scheme == head or web:
                yield from (f"{scheme}{colon}//{tail}" for colon in ((":",) if scheme != head else ()) + P.COLONS)

    given = value.strip()
    plain = reduce(lambda x, swap: re.sub("(?i)" + swap[0], swap[1], x), P.REFANG, given)
    bases = _first_of_each(x for x in (given, plain) if x)
    return _first_of_each([*bases, *(x for b in bases for x in spellings(b))])[:most]


def _first_of_each(values: Iterable[str]) -> list[str]:
    """The first spelling of each case-folded value, in order."""
    kept: dict[str, str] = {}
    for x in values:
        kept.setdefault(x.lower(), x)
    return list(kept.values())


def contains_term(text: Column, term: Column, kind: str) -> Column:
    """Whether the raw or refanged text holds the refanged term as an indicator of this kind.

    A term without an extractor of its own that is an address or a domain is looked up among those; another one of identifier
    characters must stand alone, and any other is found anywhere.
    """
    want = F.lower(F.btrim(refang(term), F.lit(BLANK)))
    listed = lambda pick, value: lambda t: F.array_contains(F.transform(pick(t), F.lower), value)
    either = lambda test: test(text) | test(refang(text))
    domain = F.btrim(want, F.lit("."))
    if kind == "domains":
        found = either(listed(domains, domain))
    elif kind == "urls":
        found = either(listed(urls, F.regexp_replace(want, P.URL_TRAIL, "")))
    elif kind in EXTRACTORS:
        found = either(listed(EXTRACTORS[kind], want))
    else:
        edges = want.rlike("^[a-z0-9_.:/-]+$")
        alone = F.concat(F.lit(r"(?iU)(?<![\w./:-])\Q"), want, F.lit(r"\E(?![\w./:-])"))
        is_domain = ~F.contains(want, F.lit("/")) & F.regexp_like(domain, F.lit(f"(?U)^(?:{P.DOMAIN})$"))
        words = F.when(edges, either(lambda t: F.regexp_like(t, alone))).otherwise(either(lambda t: F.contains(F.lower(t), want)))
        found = F.when(net.ip_number(want).isNotNull(), either(listed(ips, want))).when(is_domain, either(listed(domains, domain))).otherwise(words)
    return F.coalesce((want != "") & found, F.lit(False))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of four or more characters, as lexical evidence uses them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_.:/-]{4,}"), F.lit(0)))


def words(text: Column) -> Column:
    """Distinct lexemes of a simple configuration: lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0)))


def snippet(text: Column, term: Column, radius: int = 90) -> Column:
    """Text around the first case-insensitive occurrence, white space collapsed, dots where it is cut."""
    at = F.instr(F.lower(text), F.lower(term))
    low = F.greatest(at - 1 - radius, F.lit(0))
    high = F.least(at - 1 + F.length(term) + radius, F.length(text))
    body = F.trim(F.regexp_replace(F.substring(text, low + 1, high - low), r"(?U)\s+", " "))
    return F.when(at > 0, F.concat(F.when(low > 0, "...").otherwise(""), body, F.when(high < F.length(text), "...").otherwise(""))).otherwise("")


def normalise(text: Column, most: int = 6000) -> Column:
    """Input of an embedding model: white space collapsed, trimmed, cut."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), F.lit(most))


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def _mentions(text: Column, value: Column, kind: str) -> Column:
    edge = {"ips": (r"(?<![\w.])", r"(?![\w.])"), "domains": (r"(?<![\w.-])", r"(?![\w.-])"), "urls": (r"(?<![\w.-])", r"(?![\w.-])")}.get(kind, ("", ""))
    return F.concat(F.lit(f"(?iU){edge[0]}\\Q"), value, F.lit(f"\\E{edge[1]}"))


def contexts(text: Column, value: Column, kind: str, radius: int = 90) -> Column:
    """For each mention, the stretch between the nearest '.', ';' or line breaks, or `radius` characters where there is none."""
    marked = F.split(F.regexp_replace(F.translate(text, "\u0001\u0002", "  "), _mentions(text, value, kind), "\u0001$0\u0002"), "\u0001")

    def stretch(i: Column) -> Column:
        before = F.replace(F.array_join(F.slice(marked, F.lit(1), i), ""), F.lit("\u0002"), F.lit(""))
        hit = F.substring_index(F.get(marked, i), "\u0002", 1)
        after = F.replace(F.array_join(F.slice(marked, i + 1, F.size(marked)), ""), F.lit("\u0002"), F.lit(""))
        rest = F.substring(after, F.length(hit) + 1, F.length(after))
        cut_before = F.when(before.rlike("[.;\n]"), F.regexp_extract(before, r"([^.;\n]*)\z", 1)).otherwise(F.right(before, F.lit(radius)))
        cut_after = F.when(rest.rlike("[.;\n]"), F.regexp_extract(rest, r"^([^.;\n]*)", 1)).otherwise(F.left(rest, F.lit(radius)))
        return F.concat(cut_before, hit, cut_after)

    return F.when(F.size(marked) > 1, F.transform(F.sequence(F.lit(1), F.size(marked) - 1), stretch)).otherwise(F.array().cast("array<string>"))


def _plain(text: Column) -> Column:
    """The letters that case folding leaves among themselves, in lower case: values alike but for case are alike here too."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7f]|[kKsSiI]", ""))


def pieces(text: Column) -> Column:
    """array<struct<i, piece, plain, last>>: the text cut at line breaks and after stops; no mention of a value without blanks spans a cut."""
    parts = F.split(text, r"\n|(?<=[.;])(?=[ \t])")
    return let(parts, lambda p: F.transform(p, lambda x, i: F.struct(i.alias("i"), x.alias("piece"), _plain(x).alias("plain"), (i == F.size(p) - 1).alias("last"))))


def near(cut: Column, value: Column) -> Column:
    """The pieces that may mention the value, as one text; contexts() finds in it what it finds in the whole text."""
    own = let(_plain(value), lambda v: F.filter(cut, lambda c: F.contains(c["plain"], v)))

    def joined(o: Column) -> Column:
        text = F.array_join(F.transform(o, lambda c: c["piece"]), "\n")
        return F.concat(F.when(F.get(o, F.lit(0))["i"] > 0, "\n").otherwise(""), text, F.when(F.get(o, F.size(o) - 1)["last"], "").otherwise("\n"))

    return let(own, joined)


def disposition(text: Column, value: Column, kind: str, radius: int = 90) -> Column:
    """Role with most matches near the mentions, the order of the table breaking ties; unknown without any."""
    joined = F.array_join(contexts(text, value, kind, radius), " ")
    scored = F.array(*[F.struct(F.regexp_count(joined, F.lit(FOLDED + p)).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("label")) for i, (k, p) in enumerate(P.DISPOSITIONS.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["label"]).otherwise("unknown")


def section_default(found: Column, labels: Column) -> Column:
    """What an unknown role becomes by its section's labels."""
    has = lambda x: F.array_contains(labels, x)
    default = F.when(has("analysis_environment"), "analysis_environment").when(has("victim_infrastructure"), "victim").when(has("remediation"), "remediation_reference").when(has("ioc_listing"), "malicious").otherwise("unknown")
    return F.when(found == "unknown", default).otherwise(found)


def extraction_quality(text: Column, pages: Column) -> Column:
    """struct<quality, warnings, words, characters, chars_per_page, image_marker_count, table_marker_count, artifact_total>."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.coalesce(pages, F.lit(0)), F.lit(0))
    chars = F.length(t)
    per = F.when(n > 0, F.floor(chars / n)).otherwise(chars).cast("int")
    word = F.regexp_count(t, F.lit(r"(?U)\b[A-Za-z0-9_.:/-]{2,}\b"))
    images = F.regexp_count(t, F.lit(r"(?i)\[IMAGES DETECTED:"))
    tables = F.regexp_count(t, F.lit(r"(?i)\[TABLES DETECTED\]"))
    total = let(artifacts(t), lambda f: sum((F.size(f[k]) for k in (*EXTRACTORS, "public_ips", "non_public_ips")), F.lit(0)))
    facts = F.struct(word.alias("words"), chars.alias("characters"), per.alias("chars_per_page"), images.alias("image_marker_count"), tables.alias("table_marker_count"), total.alias("artifact_total"))
    return let(facts, lambda f: _graded(t, n, f))


def _graded(t: Column, n: Column, f: Column) -> Column:
    word, chars, per, images, tables, total = (f[k] for k in ("words", "characters", "chars_per_page", "image_marker_count", "table_marker_count", "artifact_total"))
    warnings = F.array_compact(F.array(F.when((n > 0) & (per < 250), "low_text_density"), F.when((n > 0) & (images >= F.greatest(F.lit(1), F.floor(n / 2))), "image_heavy_pdf_no_ocr"), F.when((n > 0) & (word < F.greatest(F.lit(80), n * 35)), "few_extracted_words"), F.when((n >= 3) & (total == 0), "no_cti_artifacts_extracted")))
    grade = F.when(F.btrim(t, F.lit(BLANK)) == "", "empty").when(F.size(warnings) >= 2, "low").when(F.size(warnings) == 1, "medium").otherwise("high")
    return F.struct(grade.alias("quality"), warnings.alias("warnings"), word.alias("words"), chars.alias("characters"), per.alias("chars_per_page"), images.alias("image_marker_count"), tables.alias("table_marker_count"), total.alias("artifact_total"))


def capped(values: Column, n: int) -> Column:
    """The first n values, and "... k more" where there are more."""
    more = F.size(values) - n
    return F.when(more > 0, F.concat(F.slice(values, 1, n), F.array(F.concat(F.lit("... "), more.cast("string"), F.lit(" more"))))).otherwise(values)


#: Wording and order of the one-line texts about a document.
ARTIFACT_TITLES = {"ips": "IPs", "domains": "Domains", "urls": "URLs", "emails": "Emails", "hashes": "Hashes", "cves": "CVEs", "mitre_techniques": "MITRE Techniques", "threat_actors": "Threat Actors"}
ROLES = ("malicious", "benign", "victim", "analysis_environment", "remediation_reference", "unknown")


def _line(title: str, parts: Column, between: str) -> Column:
    return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(F.lit(f"{title} | "), F.array_join(p, between))).otherwise(""))


def artifacts_line(found: Column, most: int = 20) -> Column:
    """The indicator lists as one line, `most` of each; empty without any."""
    part = lambda values, title: F.when(F.size(values) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(unique(values), 1, most), ", ")))
    return let(found, lambda f: _line("Extracted CTI Artefacts", F.array_compact(F.array(*[part(f[k], t) for k, t in ARTIFACT_TITLES.items()])), " | "))


def labels_line(labels: Column) -> Column:
    return _line("CTI Context Labels", unique(labels), ", ")


def tags_line(tags: Column) -> Column:
    return _line("CTI Behavior Tags", unique(tags), ", ")


def dispositions_line(roles: Column, most: int = 8) -> Column:
    """array<struct<type, value, disposition>> as one line, by role, `most` of each."""

    def part(role: str) -> Column:
        of = F.filter(roles, lambda r: r["disposition"] == role)
        return F.when(F.size(of) > 0, F.concat(F.lit(f"{role}: "), F.array_join(F.transform(F.slice(of, 1, most), lambda r: F.concat_ws(":", r["type"], r["value"])), ", ")))

    return _line("CTI Artifact Disposition", F.array_compact(F.array(*[part(r) for r in ROLES])), " | ")
