"""Text rules as column expressions. Every function takes and returns columns and stays inside the JVM.

Patterns spell out letters, digits and white space, so they mean the same in any regex engine.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.functions import fixed

# white space as Unicode text processing sees it, for use inside [...]
WS = (
    r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# the same characters one by one
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
WORD = r"\p{L}\p{N}_"
BEFORE = rf"(^|[^{WORD}])"
AFTER = rf"($|[^{WORD}])"


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs for v in kv])


def literal_map_of(pairs: list[tuple[str, Column]]) -> Column:
    return F.create_map(*[v for name, col in pairs for v in (F.lit(name), col)])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.regexp_replace(strip(c), rf"[{WS}]+", " ")


def words(c: Column) -> Column:
    """White-space separated words; none for blank text."""
    tidy = strip(c)
    return F.when(tidy != "", F.split(tidy, rf"[{WS}]+")).otherwise(F.array().cast("array<string>"))


def n_words(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(words(c)))  # faster than counting matches, which Spark gathers first


# --- captions ---------------------------------------------------------------------------------------------

def clean_caption(c: Column) -> Column:
    kept = squeeze(F.regexp_replace(c, rf"[^{WORD}{WS}.,!?\-'()]", ""))
    return F.when(F.length(kept) < 5, F.concat(kept, F.lit(" fashion clothing"))).otherwise(kept)


def sanitize_caption(
    c: Column,
    category: Column | None = None,
    preambles: list[str] = fixed.CAPTION_PREAMBLES,
    rewrite: bool = True,
) -> Column:
    """One-line caption without its preamble; "The … is wearing" becomes "A man/woman wearing".

    The whole phrase is replaced, so no stray letter is left behind. ``category`` decides between man and
    woman for "model" and "person".
    """
    flat = strip(F.regexp_replace(c, r"\n", " "))
    bare = let(flat, lambda x: _without_preamble(x, preambles))
    if rewrite:
        neutral = F.lit("A woman wearing")
        if category is not None:
            neutral = F.when(F.contains(category, F.lit("Men")), F.lit("A man wearing")).otherwise(neutral)
        bare = let(bare, lambda x: _rewritten(x, neutral))
    return squeeze(bare)


def _without_preamble(flat: Column, preambles: list[str]) -> Column:
    low = F.lower(F.left(flat, F.lit(max(map(len, preambles)))))
    body = F.when(F.lit(False), flat)
    for p in preambles:
        rest = strip(F.substr(flat, F.lit(len(p) + 1)))
        if p in fixed.PREAMBLES_WITH_ARTICLE:
            rest = F.concat(F.lit("A "), rest)
        body = body.when(F.startswith(low, F.lit(p.lower())), rest)
    return body.otherwise(flat)


def _rewritten(body: Column, neutral: Column) -> Column:
    pattern = "^The (model|person|man|woman) is wearing"
    subject = F.regexp_extract(body, pattern, 1)
    start = (
        F.when(subject == "man", F.lit("A man wearing"))
        .when(subject == "woman", F.lit("A woman wearing"))
        .otherwise(neutral)
    )
    tail = F.regexp_replace(body, pattern, "")
    return F.when(subject != "", F.concat(start, tail)).otherwise(body)


def has_good_start(c: Column) -> Column:
    return any_of([F.startswith(c, F.lit(s)) for s in fixed.GOOD_CAPTION_STARTS])


# --- listing search words ---------------------------------------------------------------------------------

def media_type(c: Column, aliases=fixed.MEDIA_ALIASES) -> Column:
    """Slug of one media type: the exact alias, else the first alias that contains or is contained in it."""

    def slug(key: Column) -> Column:
        near = [F.when(F.contains(key, F.lit(a)) | F.contains(F.lit(a), key), F.lit(s)) for a, s in aliases]
        known = F.try_element_at(literal_map(aliases), key)
        return F.when(F.coalesce(key, F.lit("")) == "", F.lit(fixed.DEFAULT_MEDIA)).otherwise(
            F.coalesce(known, *near, F.lit(fixed.DEFAULT_MEDIA))
        )

    return let(F.lower(strip(c)), slug)


def media_types(c: Column, aliases=fixed.MEDIA_ALIASES) -> Column:
    """Distinct slugs of a comma list in their first order; empty parts are dropped."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: strip(p) != "")
    slugs = F.array_distinct(F.transform(parts, lambda p: media_type(p, aliases)))
    return F.when(F.size(slugs) > 0, slugs).otherwise(F.array(F.lit(fixed.DEFAULT_MEDIA)))


def _latin_folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters with an ASCII compatibility form: one-to-one pairs, and those that become several letters."""
    single, plain, longer = [], [], []
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        ch = chr(code)
        out = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(out) == 1:
            single.append(ch)
            plain.append(out)
        elif len(out) > 1:
            longer.append((ch, out))
    return "".join(single), "".join(plain), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _latin_folds()


def ascii_fold(c: Column) -> Column:
    """Letters without their accents; characters with no ASCII form are dropped. Covers the Latin blocks."""
    out = F.translate(c, _FOLD_FROM, _FOLD_TO)
    several = "[" + "".join(ch for ch, _ in _FOLD_LONGER) + "]"
    spelled = out
    for ch, text in _FOLD_LONGER:
        spelled = F.replace(spelled, F.lit(ch), F.lit(text))
    out = F.when(F.rlike(out, F.lit(several)), spelled).otherwise(out)
    return F.when(F.rlike(c, F.lit(r"^[\x00-\x7f]*$")), c).otherwise(
        F.regexp_replace(out, r"[^\x00-\x7f]", "")
    )


def city_slug(c: Column) -> Column:
    slugs = literal_map(fixed.CITY_SLUGS.items())

    def slug(key: Column, plain: Column) -> Column:
        named = [
            F.when(F.contains(key, F.lit(n)) | F.contains(plain, F.lit(n)), F.lit(fixed.CITY_SLUGS[n]))
            for n in fixed.CITIES_BY_MENTION
        ]
        source = F.when(plain == "", key).otherwise(plain)
        made = F.regexp_replace(F.regexp_replace(source, "[^a-z0-9]+", "-"), "^-+|-+$", "")
        return F.coalesce(F.try_element_at(slugs, key), F.try_element_at(slugs, plain), *named, made)

    return let(F.lower(strip(c)), lambda key: let(strip(ascii_fold(key)), lambda plain: slug(key, plain)))


def city_in_text(c: Column, cities: list[str] = fixed.CITIES) -> Column:
    """Longest known city named as a whole word anywhere in the text, else null."""

    def longest(low: Column) -> Column:
        return F.coalesce(
            *[
                F.when(F.contains(low, F.lit(n)) & F.rlike(low, F.lit(BEFORE + n + AFTER)), F.lit(n))
                for n in sorted(cities, key=len, reverse=True)
            ]
        )

    return let(F.lower(c), longest)


def is_near_me(c: Column, variant: str = "server") -> Column:
    """Does the text ask for places around the writer? ``client`` uses the narrower list and ASCII borders."""
    body = "|".join(p.replace(" ", f"[{WS}]+") for p in fixed.NEAR_ME_PHRASES[variant])
    if variant == "client":
        pattern = rf"(^|[^A-Za-z0-9_])({body})($|[^A-Za-z0-9_])"
    else:
        pattern = f"{BEFORE}({body}){AFTER}"
    return F.coalesce(F.rlike(F.lower(c), F.lit(pattern)), F.lit(False))


def has_listing_intent(c: Column) -> Column:
    terms = let(
        F.coalesce(F.lower(c), F.lit("")),
        lambda low: any_of([F.contains(low, F.lit(t)) for t in fixed.LISTING_INTENT_TERMS]),
    )
    return terms | is_near_me(c)


def null_if_placeholder(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when((low == "") | low.isin(fixed.PLACEHOLDERS), F.lit(None)).otherwise(c)


def search_url(city: Column, types: Column, page: Column, base: str) -> Column:
    parts = F.transform(types, lambda t: F.concat(F.lit("type%5B%5D="), t))
    query = F.concat_ws("&", parts, F.concat(F.lit("location%5B%5D="), city))
    return F.when(page == 1, F.concat(F.lit(base + "?"), query)).otherwise(
        F.concat(F.lit(base + "page/"), page.cast("string"), F.lit("/?"), query)
    )


# --- listing fields in plain text -------------------------------------------------------------------------

def price_in_text(c: Column) -> Column:
    found = strip(F.regexp_extract(c, rf"Rs[{WS},0-9]+(/[{WORD}]+)?", 0))
    return F.when(found != "", found).otherwise(F.lit(fixed.NO_PRICE))


def size_in_text(c: Column) -> Column:
    return F.regexp_extract(c, rf"(^|[^{WORD}])([0-9]+[{WS}]*[xX][{WS}]*[0-9]+)($|[^{WORD}])", 2)


def codes_in_text(c: Column, zone: Column | None = None) -> Column:
    """Sorted distinct media codes: 4-6 capitals or digits inside a zone, else whole five-letter words."""
    loose = F.regexp_extract_all(c, F.lit(rf"(?<![{WORD}])[A-Z0-9]{{5}}(?![{WORD}])"), 0)
    if zone is not None:
        inside = F.regexp_extract_all(zone, F.lit("[A-Z0-9]{4,6}"), 0)
        loose = F.when(zone.isNotNull(), inside).otherwise(loose)
    return F.array_sort(F.array_distinct(loose))


def total_in_text(c: Column) -> Column:
    hit = F.rlike(c, F.lit(rf"(?i)[0-9]+[{WS}]+OOH Media Found"))
    return F.when(hit, F.regexp_extract(c, "([0-9]+)", 1).cast("bigint"))


# --- model replies ----------------------------------------------------------------------------------------

def strip_code_fences(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, rf"^[{WS}]*```[a-zA-Z0-9_-]*[{WS}]*\n?", "")
    return strip(F.regexp_replace(s, rf"\n?[{WS}]*```[{WS}]*$", ""))


def finalize_html(c: Column) -> Column:
    """Fence-free page with a closing tag and a doctype; blank text stays blank."""
    raw = strip_code_fences(c)
    closed = F.when(F.contains(F.lower(raw), F.lit("</html>")), raw).otherwise(
        F.concat(F.regexp_replace(raw, rf"[{WS}]+$", ""), F.lit("\n</html>"))
    )
    typed = F.when(F.rlike(closed, F.lit(rf"(?i)^<!doctype[{WS}]+html")), closed).otherwise(
        F.concat(F.lit("<!DOCTYPE html>\n"), closed)
    )
    return F.when(raw == "", F.lit("")).otherwise(typed)


def unwrap_fence(c: Column) -> Column:
    """Text inside the first fenced block (json blocks first), or the whole text."""
    s = strip(c)
    tagged = strip(F.split_part(F.split_part(s, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
    plain = strip(F.split_part(s, F.lit("```"), F.lit(2)))
    return F.when(F.contains(s, F.lit("```json")), tagged).when(F.contains(s, F.lit("```")), plain).otherwise(s)


def reply_text(c: Column, start: str = fixed.REPLY_START, end: str = fixed.REPLY_END) -> Column:
    after = F.substring_index(F.substring_index(c, start, -1), end, 1)
    return strip(F.when(F.contains(c, F.lit(start)), after).otherwise(c))


def strip_tool_tags(c: Column, tools: list[str] = fixed.TOOLS) -> Column:
    """Reply without tool tags and the rest of their lines; an empty rest becomes the stock reply."""
    out = c
    for tool in tools:
        out = F.regexp_replace(out, rf"<{tool}>[^\n]*", "")
    out = strip(F.regexp_replace(out, rf"\n[{WS}]*\n", "\n\n"))
    return F.when(out == "", F.lit(fixed.STOCK_REPLY)).otherwise(out)


def fill_template(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def training_prompt(instruction: Column, extra: Column, output: Column, system: str) -> Column:
    ask = F.when(F.length(F.coalesce(extra, F.lit(""))) > 0, F.concat(instruction, F.lit("\n\n"), extra)).otherwise(
        instruction
    )
    return F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"),
        ask,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"),
        output,
        F.lit("<|im_end|>"),
    )


# --- chats, titles, times ---------------------------------------------------------------------------------

def chat_title(c: Column) -> Column:
    return F.when(F.length(c) > 50, F.concat(F.left(c, F.lit(50)), F.lit("..."))).otherwise(c)


def title_matches(title: Column, query: str) -> Column:
    if not query.strip():
        return F.lit(True)
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(query.lower()))


def db_timestamp(c: Column) -> Column:
    """ISO text with Z, an offset or neither; fractions beyond microseconds are cut. Bad text gives null."""
    return F.regexp_replace(c, r"(\.\d{6})\d+", "$1").try_cast("timestamp")


def mask_secret(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(8)), F.lit("..."), F.right(c, F.lit(4)))


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


# --- API errors -------------------------------------------------------------------------------------------

def api_error(c: Column) -> Column:
    """Struct that sorts an API error text into quota, invalid or error, with limits and reset time."""
    low = F.lower(c)
    quota = F.contains(low, F.lit("quota")) | F.contains(low, F.lit("limit"))
    invalid = F.contains(low, F.lit("api key not valid")) | F.contains(low, F.lit("invalid"))
    kind = F.when(quota, F.lit("quota")).when(invalid, F.lit("invalid")).otherwise(F.lit("error"))

    limit = F.regexp_extract(c, rf"quota_value:[{WS}]*([0-9]+)", 1).try_cast("bigint")
    seconds = F.regexp_extract(c, rf"(?s)retry_delay.*?seconds:[{WS}]*([0-9]+)", 1).try_cast("bigint")
    named = F.regexp_extract(c, rf'quota_metric:[{WS}]*"([^"]+)"', 1)
    metric = F.when(named != "", named).otherwise(F.lit("Unknown"))
    daily = F.contains(metric, F.lit("PerDay"))
    minute = F.contains(metric, F.lit("PerMinute"))

    shown = F.coalesce(limit.cast("string"), F.lit("None"))
    capacity = (
        F.when(~quota & invalid, F.lit("N/A"))
        .when(~quota, F.lit("Unknown"))
        .when(daily & (F.coalesce(limit, F.lit(0)) > 0), F.concat(F.lit("0 of "), shown, F.lit(" daily images")))
        .when(minute, F.concat(F.lit("Per-minute limit hit ("), shown, F.lit("/min)")))
        .otherwise(F.lit("Quota exceeded"))
    )
    message = (
        F.when(quota, F.lit("Quota exceeded")).when(invalid, F.lit("Invalid API key")).otherwise(F.left(c, F.lit(50)))
    )
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    resets = F.when(
        quota & (seconds > 0),
        F.concat(
            F.lit("Resets in "),
            F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(F.lit("")),
            minutes.cast("string"),
            F.lit("m"),
        ),
    )
    retry = (
        F.when(F.contains(low, F.lit("invalid")) & F.contains(low, F.lit("api")), F.lit("next_key"))
        .when(
            any_of([F.contains(low, F.lit(t)) for t in ("quota", "rate", "429")]), F.lit("next_key_after_wait")
        )
        .otherwise(F.lit("give_up"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(quota, limit).alias("limit"),
        F.when(quota, seconds).alias("retry_seconds"),
        F.when(quota, metric).alias("metric"),
        (quota & daily).alias("is_daily"),
        (quota & minute).alias("is_per_minute"),
        capacity.alias("capacity"),
        resets.alias("resets"),
        retry.alias("retry"),
        message.alias("message"),
    )


# --- media references -------------------------------------------------------------------------------------

def media_reference(uri: Column) -> Column:
    """Struct (mime, extension, folder, content) of a data URI or of bare base64, which counts as PNG."""
    is_uri = F.startswith(uri, F.lit("data:"))
    head = F.split_part(uri, F.lit(","), F.lit(1))
    mime = F.when(is_uri, F.lower(F.split_part(F.substr(head, F.lit(6)), F.lit(";"), F.lit(1))))
    extension = F.when(is_uri, extension_for_mime(mime)).otherwise(F.lit("png"))
    folder = F.when(F.startswith(mime, F.lit("video/")), F.lit("generated_videos")).otherwise(
        F.lit("generated_images")
    )
    comma = F.instr(uri, ",")
    payload = F.when(~is_uri, uri).when(comma > 0, F.substr(uri, comma + 1)).otherwise(F.lit(""))
    return F.struct(
        mime.alias("mime"),
        extension.alias("extension"),
        folder.alias("folder"),
        F.unbase64(payload).alias("content"),
    )


def extension_for_mime(mime: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.EXTENSION_BY_MIME.items()), mime), F.lit("bin"))


def extension_for_content(kind: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(fixed.EXTENSION_BY_CONTENT.items()), F.lower(kind)), F.lit("txt")
    )


def content_type_for_extension(extension: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(fixed.CONTENT_TYPE_BY_EXTENSION.items()), F.lower(extension)),
        F.lit("application/octet-stream"),
    )


def message_type_for_tool(tool: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(fixed.MESSAGE_TYPE_BY_TOOL.items()), tool), F.lit("text")
    )


def is_video_file(url: Column) -> Column:
    return F.coalesce(
        F.startswith(url, F.lit("data:video/")) | F.rlike(url, F.lit(r"(?i)\.(mp4|webm|mov)(\?|$)")),
        F.lit(False),
    )


def sniff_mime(content: Column) -> Column:
    """MIME type of generated video bytes by their first 32 bytes."""
    head = F.hex(F.substring(content, 1, 32))
    # 66747970 = "ftyp", 52494646 = "RIFF", 57454250 = "WEBP"; matches sit on whole bytes
    ftyp = F.rlike(head, F.lit("^(..)*66747970"))
    webp = F.startswith(head, F.lit("52494646")) & F.rlike(F.left(head, F.lit(32)), F.lit("^(..)*57454250"))
    return F.when(~ftyp & webp, F.lit("image/webp")).otherwise(F.lit("video/mp4"))


MARKDOWN_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def markdown_parts(c: Column) -> Column:
    """Ordered array of (kind, value, alt): text and image parts of a markdown reply; empty text is dropped."""
    texts = F.split(c, MARKDOWN_IMAGE, -1)
    alts = F.regexp_extract_all(c, F.lit(MARKDOWN_IMAGE), 1)
    urls = F.regexp_extract_all(c, F.lit(MARKDOWN_IMAGE), 2)

    def part(kind, value, alt):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), alt.alias("alt"))

    pairs = F.transform(
        texts,
        lambda t, i: F.array(
            part("text", t, F.lit(None).cast("string")), part("image", F.get(urls, i), F.get(alts, i))
        ),
    )
    kept = F.filter(F.flatten(pairs), lambda p: p["value"].isNotNull() & (p["value"] != ""))
    empty = F.array(part("text", c, F.lit(None).cast("string")))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, empty).otherwise(kept)


# --- URLs and addresses -----------------------------------------------------------------------------------

def absolute_url(url: Column, base: Column) -> Column:
    """``url`` resolved against ``base``; anything that starts with http is left alone."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.split_part(base, F.lit("#"), F.lit(1))
    no_query = F.split_part(no_fragment, F.lit("?"), F.lit(1))
    folder = F.regexp_replace(F.substr(no_query, F.length(host) + 1), "[^/]*$", "")

    def inside(u: Column) -> Column:
        path = F.regexp_extract(u, "^[^?#]*", 0)
        rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
        )
        return F.concat(host, let(rooted, _without_dots), F.regexp_extract(u, "[?#].*$", 0))

    return let(
        url,
        lambda u: F.when(F.startswith(u, F.lit("http")), u)
        .when(u == "", base)
        .when(F.startswith(u, F.lit("//")), F.concat(scheme, F.lit(":"), u))
        .when(F.rlike(u, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), u)
        .when(F.startswith(u, F.lit("#")), F.concat(no_fragment, u))
        .when(F.startswith(u, F.lit("?")), F.concat(no_query, u))
        .when(u.isNotNull(), inside(u)),
    )


def _without_dots(path: Column) -> Column:
    """Path with its "." and ".." steps worked out."""
    steps = F.aggregate(
        F.split(F.substr(path, F.lit(2)), "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    end = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    tidy = F.regexp_replace(F.concat(F.lit("/"), F.array_join(steps, "/"), end), "^//+", "/")
    return F.when(F.rlike(path, F.lit(r"/\.")), tidy).otherwise(path)


def image_url(attrs: Column, priority: list[str], base: Column) -> Column:
    """Image address of one element from its attribute map: background image, priority list, then src."""
    style = F.coalesce(F.try_element_at(attrs, F.lit("style")), F.lit(""))
    background = F.when(
        F.contains(style, F.lit("background-image")) & F.rlike(style, F.lit(r"url\(['\"]?(.*?)['\"]?\)")),
        F.regexp_extract(style, r"url\(['\"]?(.*?)['\"]?\)", 1),
    )

    def last_candidate(value: Column) -> Column:
        parts = F.filter(F.transform(F.split(value, ","), strip), lambda p: p != "")
        return F.coalesce(
            let(parts, lambda ps: F.get(F.split(F.get(ps, F.size(ps) - 1), rf"[{WS}]+"), F.lit(0))), value
        )

    choices = [background]
    for name in [*priority, "src"]:
        value = F.try_element_at(attrs, F.lit(name))
        value = F.when(value != "", value)
        choices.append(let(value, last_candidate) if "srcset" in name else value)
    return absolute_url(F.coalesce(*choices), base)


def keep_url(c: Column, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    keep = any_of([F.contains(c, F.lit(t)) for t in includes]) if includes else F.lit(True)
    return keep & ~any_of([F.contains(c, F.lit(t)) for t in excludes])


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    first = strip(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(F.length(forwarded) > 0, first).when(F.length(real) > 0, strip(real)).otherwise(peer)


# IPv4 blocks that are not public, written over the dotted text, and the two public hosts inside one of them
PRIVATE_V4 = (
    r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!9$|10$)|192\.0\.2\.|192\.168\.|"
    r"198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24[0-9]\.|25[0-5]\.)"
)
PRIVATE_V6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:0?db8:|::ffff:|100::|2001:[0-1]?[0-9a-f]{0,2}::?)"


def is_private_ip(ip: Column) -> Column:
    """True for private, loopback, link-local or unreadable addresses."""
    low = F.lower(strip(F.split_part(F.coalesce(ip, F.lit("")), F.lit(","), F.lit(1))))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    is_v4 = F.rlike(low, F.lit(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
    is_v6 = F.rlike(low, F.lit(r"^[0-9a-f]*:[0-9a-f:]*:[0-9a-f:.]*(%.+)?$"))
    return F.when(is_v4, F.rlike(low, F.lit(PRIVATE_V4))).when(is_v6, F.rlike(low, F.lit(PRIVATE_V6))).otherwise(F.lit(True))
