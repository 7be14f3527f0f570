"""Column expressions over texts, URLs and pages. All stay in the JVM; each takes and gives Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic; the index drops them, the query filter doesn't.
STOPWORDS = tuple(sorted(set(
    "its so no then them out about up will if their how do he she which each use there can your when we were all what but not had have has "
    "be are was this that it as from by at with on for or and of to in is an a the".split()
)))
TOKEN = "[a-z0-9]+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """All lower-case alphanumeric runs, in order."""
    return F.regexp_extract_all(F.lower(c(text)), F.lit(TOKEN), F.lit(0))


def index_token(token: Column) -> Column:
    """Whether the index keeps a token."""
    return (F.length(token) > 1) & ~token.isin(*STOPWORDS)


def doc_id(content: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(c(content), 256), 1, 16))


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


def truncate(text: Column | str, n: int, suffix: str = "...") -> Column:
    """At most n characters, suffix included."""
    t = c(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - len(suffix))), F.lit(suffix)))


def word_count(text: Column | str) -> Column:
    t = squeeze(text)
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def tokens_by_words(text: Column | str) -> Column:
    """1.3 tokens a word, 1 at least, 0 for blank text."""
    n = word_count(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 13 / 10)))


def tokens_by_length(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c(text)) / 4))


def title_tag(html: Column | str) -> Column:
    r"""\b and \s as SQL reads them: of ASCII, and without the vertical tab."""
    return F.trim(F.regexp_extract(c(html), r"(?is)<title(?![A-Za-z0-9_])[^>]*>(.*?)</title[\t\n\f\r ]*>", 1))


def first_h1(html: Column | str) -> Column:
    """The source of the first h1, which may be blank; references and tags in it stand as they are."""
    return F.trim(F.regexp_extract(c(html), "(?is)<h1[^>]*>(.*?)</h1>", 1))


def looks_binary(text: Column | str) -> Column:
    """Over 30 % of the first 512 characters are control characters."""
    head = F.substring(c(text), 1, 512)
    return F.when(F.length(head) == 0, False).otherwise(F.length(F.regexp_replace(head, r"[^\x00-\x08\x0E-\x1F]", "")) / F.length(head) > 0.3)


def looks_html(text: Column | str) -> Column:
    return c(text).rlike("<[A-Za-z][^>]*>")


def looks_json(text: Column | str) -> Column:
    t = F.ltrim(c(text))
    return (t.startswith("{") | t.startswith("[")) & F.try_parse_json(c(text)).isNotNull()


def plain_to_html(text: Column | str) -> Column:
    """Each non-blank line as an escaped paragraph."""
    t = F.replace(F.replace(F.replace(c(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), F.trim(x), F.lit("</p>"))), "\n")


def strip_tags(html: Column | str) -> Column:
    t = F.regexp_replace(c(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>", " ")
    return squeeze(F.regexp_replace(t, "<[^>]+>", " "))


_SPA = r'(?i)(id="(root|app|__next|__nuxt)"[^>]*>\s*</|ng-app|data-reactroot|window\.__INITIAL_STATE__)'


def needs_rendering(html: Column | str) -> Column:
    """A page that says it needs scripts, is an empty application shell, or is long with hardly any text."""
    h = c(html)
    return h.rlike(r"(?is)<noscript[^>]*>[^<]*(enable|requires?|need)[^<]*javascript") | h.rlike(_SPA) | ((F.length(h) > 1000) & (F.length(strip_tags(h)) < 0.05 * F.length(h)))


def netloc(url: Column | str) -> Column:
    """Authority of an absolute URL, port included; empty for others."""
    return F.regexp_extract(c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site_id(url: Column | str, file: Column | None = None) -> Column:
    local = F.lit("local") if file is None else F.when(file.contains("/"), F.concat(F.lit("local:"), F.element_at(F.split(file, "/"), -2))).otherwise("local")
    return F.when(F.length(netloc(url)) > 0, netloc(url)).otherwise(local)


def normalize_url(url: Column | str) -> Column:
    """Without fragment, and without a slash at the end unless the path is the root."""
    u = F.regexp_replace(c(url), "#.*$", "")
    return F.when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*/$"), u).otherwise(F.regexp_replace(u, "/+$", ""))


NON_HTML = tuple("7z avi bmp css csv doc docx eot exe flv gif gz ico jpeg jpg js json mov mp3 mp4 pdf png ppt pptx rar svg tar ttf webp woff woff2 xls xlsx xml zip".split())


def non_html(url: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(url_path(url), r"\.([A-Za-z0-9]+)$", 1))
    return ext.isin(*NON_HTML)


def domain_slug(domain: Column | str) -> Column:
    d = F.regexp_replace(F.lower(c(domain)), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(d, r"\.[a-z]+$", ""), "[._]", "-")


SECRET_KEYS = ("access_token", "api-key", "api_key", "apikey", "auth", "key", "password", "secret", "session", "sig", "token")


def redact(url: Column | str) -> Column:
    """Values of secret query keys replaced."""
    return F.regexp_replace(c(url), "(?i)([?&](?:" + "|".join(SECRET_KEYS) + ")=)[^&#]*", "$1<redacted>")


SECRET_HEADERS = r"(?i)^(authorization|cookie|set-cookie|proxy-authorization|x-api-key|x-auth.*|.*token.*)$"


def redact_headers(headers: Column | str) -> Column:
    return F.transform_values(c(headers), lambda k, v: F.when(k.rlike(SECRET_HEADERS), F.lit("<redacted>")).otherwise(v))


def sentences(text: Column | str) -> Column:
    return F.split(F.trim(c(text)), r"(?<=[!?.])\s+")


def block_summary(text: Column | str) -> Column:
    return F.trim(F.substring_index(F.substring(c(text), 1, 100), ".", 1))


def evidence_score(kind: Column, text: Column, has_entities: Column, has_provenance: Column) -> Column:
    n = F.length(text)
    score = (
        F.lit(0.3) + F.when(kind.isin("table", "code", "product_spec"), 0.3).when(kind.isin("heading", "list", "faq"), 0.1).otherwise(0.0)
        + F.when(has_entities, 0.15).otherwise(0.0) + F.when(has_provenance, 0.1).otherwise(0.0) + F.when(n > 200, 0.1).when(n > 50, 0.05).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


# --- entities, as array<string> per type

_MONTHS = tuple("December November October September August July June May April March February January".split())
MONTH = "(?:" + "|".join(_MONTHS + tuple(m[:3] for m in _MONTHS)) + ")"
UNITS = "|".join("bytes? files? pages? users? items? requests? years? months? weeks? days? secs? seconds? mins? minutes? hrs? hours? TB KB MB GB rem em pt px L l ml oz lb kg g mg mi yd ft in km m cm mm".split())
_N = "[0-9]"
ENTITY: dict[str, list[str]] = {
    "date": [rf"(?i)\b{MONTH}\s+{_N}{_N}?(?:,?\s+{_N}{{4}})?\b", rf"\b{_N}{{4}}-{_N}{_N}-{_N}{_N}\b", rf"\b{_N}{_N}?/{_N}{_N}?/{_N}{{4}}\b"],
    "price": [rf"[€$¥£]\s?{_N}[0-9,]*(?:[.]{_N}{_N}?)?"],
    "email": [r"\b[\w.%+-]+@(?:[^\W_]|[.-])+[.](?:[a-z]|[A-Z]){2,}\b"],
    "url": [r"https?://[^)\]'\"<>\s]+"],
    "phone": [rf"(?:[+]{_N}{{1,3}}[\s.-]?)?(?:[(]?{_N}{{2,4}}[)]?[\s.-])?{_N}{{2,4}}[\s.-]{_N}{{3,4}}(?:[\s.-]{_N}{{3,4}})?"],
    "percentage": [rf"\b{_N}+(?:[.]{_N}+)?%"],
    "number_with_unit": [rf"\b{_N}[0-9,]*(?:[.]{_N}+)?\s?(?:{UNITS})\b"],
}


#: Edges of ASCII words: at a pattern's end, where a word character came before; before a digit; before a letter; before what stands in an address.
_END, _DIGIT, _LETTER, _EITHER = r"(?![A-Za-z0-9_])", r"(?=[0-9])(?<![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?=[.%+-])(?<=[A-Za-z0-9_]))"
_SPACES = r"\t\n\f\r "


def jvm(pattern: str) -> str:
    r"""The pattern as SQL reads it, said so that the JVM reads it alike: \b is an edge of ASCII words (up to Java 18 letters of any script count),
    \s has no vertical tab, and under (?i) the long s and the Kelvin sign are s and k. Repeated choices are classes, as their recursion overflows the stack.
    """
    p = pattern.replace(r"(?:[^\W_]|[.-])+", "[A-Za-z0-9.-]+").replace("(?:[a-z]|[A-Z]){2,}", "[A-Za-z]{2,}").replace(r"[\w.%+-]+@", r"[\w.%+-]++@")
    fold, inside, out, i = p.startswith("(?i)"), False, [], 4 if p.startswith("(?i)") else 0
    while i < len(p):
        x = p[i : i + 2] if p[i] == "\\" else p[i]
        i += len(x)
        if x == r"\b" and not inside:
            x = _END if i == len(p) else _DIGIT if p.startswith(_N, i) else _LETTER if p.startswith(MONTH, i) else _EITHER
        elif x == r"\s":
            x = _SPACES if inside else f"[{_SPACES}]"
        elif fold and not inside and x in "sSkK":
            x = "[sſ]" if x in "sS" else "[kK]"
        elif x in "[]":
            inside = x == "["
        out.append(x)
    return "(?i)" * fold + "".join(out)


def entities(text: Column | str, kind: str) -> Column:
    found = [F.regexp_extract_all(c(text), F.lit(jvm(p)), F.lit(0)) for p in ENTITY[kind]]
    return F.concat(*found) if len(found) > 1 else found[0]


# --- salience

TYPE_WEIGHT = {"heading": 0.9, "paragraph": 0.7, "table": 0.8, "code": 0.7, "list": 0.6, "quote": 0.5, "figure_caption": 0.6, "image": 0.5, "product_spec": 0.9, "faq": 0.7, "metadata": 0.3}
#: Words as runs of letters, digits and underscores of any script; the patterns below hold for a whole word, so no word boundary is needed, which engines read differently.
WORD_RUN, DATE_WORD, NAME_WORD = r"[\p{L}\p{N}_]+", "(?i)^(?:(?:19|20)\\p{Nd}{2}|" + "|".join(_MONTHS) + ")$", "^[A-Z][a-z]{2,}$"


#: The same for counting in one pass over the text: whole words by what stands before and after them.
_WORD_CHAR = r"[\p{L}\p{N}_]"
_DATES = rf"(?i)(?=[12DNOSAJMFſ])(?<!{_WORD_CHAR})(?:(?:19|20)\p{{Nd}}{{2}}|" + "|".join(m.replace("S", "[Sſ]").replace("s", "[sſ]") for m in _MONTHS) + rf")(?!{_WORD_CHAR})"
_NAMES = rf"(?=[A-Z])(?<!{_WORD_CHAR})[A-Z][a-z]{{2,}}+(?!{_WORD_CHAR})"


def length_score(text: Column) -> Column:
    return 1 / (1 + F.exp(-(F.length(text) - 100) / F.lit(50.0)))


def entity_density(text: Column) -> Column:
    """Numbers, dates and capitalised words for each character, squashed to 0..1."""
    n = sum((F.regexp_count(text, F.lit(p)) for p in (_DATES, _NAMES)), F.regexp_count(text, F.lit(r"\p{Nd}+")))
    return F.when(F.length(text) == 0, 0.0).otherwise(2 / (1 + F.exp(-100.0 * n / F.length(text))) - 1)


def link_density(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(rf"[^{_SPACES}]+"))
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"https?://\S+")) / F.greatest(n, F.lit(1)))


def salience(kind: Column, text: Column, index: Column, total: Column, section: Column, dom_path: Column, density: Column | None = None, links: Column | None = None) -> Column:
    """0..1 from type, position, richness, structure and context. density, links: of the text, where they are columns already."""
    weight = F.coalesce(*[F.when(kind == k, F.lit(float(v))) for k, v in TYPE_WEIGHT.items()], F.lit(0.5))
    position = F.when(total <= 1, 1.0).otherwise(1 - 0.7 * index / (total - 1))
    low = F.lower(dom_path)
    tags = sum((F.when(low.contains(t), 0.3).otherwise(0.0) for t in ("main", "article", "section")), F.lit(0.0))
    rich = 0.4 * length_score(text) + 0.3 * (entity_density(text) if density is None else density) + 0.3 * (1 - (link_density(text) if links is None else links))
    structure = 0.4 * F.when((kind == "heading") | (F.size(section) > 0), 1.0).otherwise(0.0) + 0.3 * F.greatest(F.lit(0.0), 1 - F.regexp_count(dom_path, F.lit(">")) / 20) + 0.3 * F.when(kind.isin("table", "code", "product_spec"), 1.0).otherwise(0.0)
    context = 0.5 * F.when(low.contains("main") | low.contains("article"), 1.0).otherwise(0.0) + 0.5 * F.least(F.lit(1.0), tags)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 * weight + 0.15 * position + 0.2 * rich + 0.2 * structure + 0.2 * context))


# --- intents

_TASK = r"(?i)\b(upload|open|navigate|go\s+to|submit|fill|click|download)\b|\bfind\s+the\s+button\b"
_TASK_ONLY = r"(?i)\b(upload|submit|fill|click|download)\b"
_EVIDENCE = r"(?i)\b(excerpt|quote|citation|source|evidence|prove|show\s+me)\b"
_NAVIGATION = r"(?i)\b(navigate\s+to|visit|open|go\s+to)\b|\b(contact\s+page|about\s+page|home\s*page|pricing\s+page)\b"


def intent(query: Column | str) -> Column:
    q = c(query)
    task, evidence, nav = q.rlike(_TASK), q.rlike(_EVIDENCE), q.rlike(_NAVIGATION)
    n = task.cast("int") + evidence.cast("int") + nav.cast("int")
    return (
        F.when(n == 0, "fact").when(task & nav & ~evidence, F.when(q.rlike(_TASK_ONLY), "task").otherwise("navigation"))
        .when(n > 1, "hybrid").when(task, "task").when(evidence, "evidence").otherwise("navigation")
    )


def intent_confidence(query: Column | str) -> Column:
    k, n = intent(query), word_count(query)
    base = F.when(k == "navigation", 0.8).when(k.isin("task", "evidence"), 0.7).when(k == "fact", 0.6).otherwise(0.4)
    return F.round(F.when(n < 3, base * 0.8).when(n > 8, F.least(F.lit(1.0), base * 1.1)).otherwise(base), 2)


def stop_condition(kind: Column) -> Column:
    return F.when(kind == "evidence", "high_confidence_evidence").when(kind == "navigation", "action_found").when(kind == "task", "task_complete").otherwise("enough_evidence")
