"""URL functions: three canonical forms and three kind classifiers, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that each form drops, besides those that start with utm_.
DROPPED = {
    "capture": ("si", "igshid", "igsh", "fbclid", "gclid", "msclkid", "ref", "ref_src", "ref_url", "spm", "s"),
    "resolve": ("si", "igshid", "fbclid", "ref"),
    "import": ("si", "igshid", "fbclid", "gclid"),
}
#: Hosts that only forward to others.
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "amzn.to", "lnkd.in", "goo.gl")
#: Scheme, host, port, path, query of an http(s) URL; the fragment is left out.
SHAPE = r"(?i)^\s*(https?)://([^/?#:\s]+)(?::(\d+))?([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?\s*$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, SHAPE, k)


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(SHAPE), F.lit(False))


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host_of(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path_of(url: Column) -> Column:
    own = _part(url, 4)
    return F.when(own == "", "/").otherwise(own)


def _port(url: Column) -> Column:
    """``:port`` unless it is the scheme's own."""
    own, scheme = _part(url, 3), scheme_of(url)
    default = (own == "") | ((scheme == "http") & (own == "80")) | ((scheme == "https") & (own == "443"))
    return F.when(default, "").otherwise(F.concat(F.lit(":"), own))


def _kept_params(url: Column, form: str) -> Column:
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    every = F.filter(F.split(_part(url, 5), "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*DROPPED[form]))
    return F.transform(every, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))


def _query(params: Column) -> Column:
    return F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")


def canonical(url: Column, form: str) -> Column:
    """The canonical form of a URL for ``capture``, ``resolve`` or ``import``.

    capture: parameters sorted by name, trailing slashes off unless root, null if no
    URL. resolve: ``www.`` off, aliases and short links of known hosts rewritten, one
    trailing slash and the port off, trimmed input if no URL. import: order kept, one
    trailing slash off where nothing follows it, trimmed lower case if no URL.
    """
    scheme, host, path, params = scheme_of(url), host_of(url), path_of(url), _kept_params(url, form)
    if form == "capture":
        by_name = F.array_sort(F.transform(F.arrays_zip(F.transform(params, lambda p: F.split_part(p, F.lit("="), F.lit(1))).alias("n"), F.transform(params, lambda p, i: i).alias("i"), params.alias("p")), lambda s: F.struct(s["n"], s["i"], s["p"])))
        query = _query(F.transform(by_name, lambda s: s["p"]))
        cut = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
        return F.when(is_http(url), F.concat(scheme, F.lit("://"), host, _port(url), F.when(cut == "", "/").otherwise(cut), query))
    if form == "import":
        whole = F.concat(scheme, F.lit("://"), host, _port(url), path, _query(params))
        cut = F.when((path != "/") & whole.endswith("/"), F.left(whole, F.length(whole) - 1)).otherwise(whole)
        return F.when(is_http(url), cut).otherwise(F.lower(F.trim(url)))
    bare = F.regexp_replace(host, r"^www\.", "")
    alias = F.when(bare == "m.youtube.com", "youtube.com").when(bare == "twitter.com", "x.com").otherwise(bare)
    video = F.concat(F.lit("https://youtube.com/watch?v="), F.regexp_extract(path, "^/+([^/]+)", 1), F.array_join(F.transform(F.filter(params, lambda p: F.split_part(p, F.lit("="), F.lit(1)) != "v"), lambda p: F.concat(F.lit("&"), p)), ""))
    repo = F.regexp_extract(path, "^/+([^/]+)/+([^/]+)", 2)
    project = F.concat(F.lit("https://github.com/"), F.regexp_extract(path, "^/+([^/]+)/+([^/]+)", 1), F.lit("/"), F.regexp_replace(repo, r"\.git$", ""))
    plain = F.concat(scheme, F.lit("://"), alias, F.regexp_replace(path, "/$", ""), _query(params))
    return F.when(~is_http(url), F.trim(url)).when(bare == "youtu.be", video).when((alias == "github.com") & (repo != ""), project).otherwise(plain)


def url_hash(canonical_url: Column) -> Column:
    return F.sha2(canonical_url, 256)


def _on(host: Column, names: tuple[str, ...]) -> Column:
    """A host or a subdomain of it."""
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return out


def kind(url: Column, profile: str) -> Column:
    """What a URL points to, by the rules of one profile."""
    if profile == "capture":
        host, path = host_of(url), F.lower(path_of(url))
        social = [f"{w}{h}" for h in ("instagram.com", "x.com", "twitter.com", "threads.net", "tiktok.com", "reddit.com") for w in ("", "www.")]
        return (
            F.when(_on(host, ("github.com",)), "github")
            .when(host.isin("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com", "vimeo.com", "www.vimeo.com"), "video")
            .when(host.isin(*social), "social")
            .when(host.isin("open.spotify.com", "soundcloud.com", "www.soundcloud.com", "podcasts.apple.com"), "audio")
            .when(path.endswith(".pdf"), "pdf")
            .otherwise("article")
        )
    if profile == "resolve":
        own = canonical(url, "resolve")
        host, path = host_of(own), F.lower(path_of(own))
        return (
            F.when(~is_http(own), "other")
            .when(host == "github.com", "github")
            .when(host == "youtube.com", "video")
            .when(host.isin("x.com", "instagram.com", "threads.net", "threads.com"), "social")
            .when((host == "arxiv.org") | path.endswith(".pdf"), "pdf")
            .when(host.isin("soundcloud.com", "open.spotify.com", "anchor.fm") | path_extension(path).isin(".mp3", ".wav", ".m4a", ".ogg", ".flac"), "audio")
            .otherwise("article")
        )
    host, path = host_of(url), F.lower(path_of(url))
    return (
        F.when(~is_http(url), "other")
        .when(_on(host, ("github.com", "gist.github.com")), "github")
        .when(_on(host, ("youtube.com", "youtu.be", "vimeo.com", "tiktok.com")), "video")
        .when(_on(host, ("twitter.com", "x.com", "instagram.com", "threads.net", "facebook.com", "linkedin.com", "reddit.com")), "social")
        .when(_on(host, ("arxiv.org",)) | path.endswith(".pdf"), "pdf")
        .otherwise("article")
    )


def path_extension(path: Column) -> Column:
    """The last ``.ext`` of a path, if it is in its last segment."""
    return F.regexp_extract(path, r"\.[^./]*$", 0)


def trimmed_url(found: Column) -> Column:
    """A URL without the punctuation of the sentence around it; a closing bracket stays while it has its opener.

    There are as many steps as there are such characters at the end.
    """
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))

    def once(s: Column) -> Column:
        last = F.right(s, F.lit(1))
        loose = last.isin(".", ",", "!", "?", ":", ";", '"', "'", "*", "`")
        for close, open_ in ((")", "("), ("]", "["), ("}", "{")):
            loose = loose | ((last == close) & (count(s, close) > count(s, open_)))
        return F.when(loose, F.left(s, F.length(s) - 1)).otherwise(s)

    tail = F.length(F.regexp_extract(found, r"[.,!?:;\"'*`)\]}]*$", 0))
    return F.aggregate(F.slice(F.sequence(F.lit(0), tail), F.lit(2), F.greatest(tail, F.lit(1))), found, lambda acc, _: once(acc))


def urls_in(text: Column) -> Column:
    """Every URL of a text, in order; bare ``www.`` gets a scheme."""
    raw = F.regexp_extract_all(text, F.lit(r"(?i)(https?://\S+|\bwww\.\S+)"), F.lit(1))
    own = F.filter(F.transform(raw, lambda u: trimmed_url(u)), lambda u: u != "")
    return F.transform(own, lambda u: F.when(F.lower(F.left(u, F.lit(4))) == "www.", F.concat(F.lit("https://"), u)).otherwise(u))


def shared(url_field: Column, text_field: Column) -> tuple[Column, Column]:
    """URL and note of a share: the URL field, else the first URL in the text, else one inside the URL field."""
    first = lambda t: F.regexp_replace(F.regexp_extract(t, r"(?i)https?://\S+", 0), r"[.,!?)\]}'\">]+$", "")
    rest = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?is)^(.*?)https?://\S+(.*)$", "$1 $2"), r"\s+", " "))
    in_text, in_url = first(text_field), first(url_field)
    url = F.when(is_http(url_field), url_field).when(in_text != "", in_text).when(in_url != "", in_url)
    both = F.array_join(F.filter(F.array(rest(url_field), F.trim(text_field)), lambda x: x != ""), "\n\n")
    note = F.when(is_http(url_field), F.trim(text_field)).when(in_text != "", rest(text_field)).when(in_url != "", both)
    return url, F.nullif(note, F.lit(""))


def fallback_title(url: Column) -> Column:
    """The last path segment, decoded; the URL itself if there is none, or if it is no URL or not decodable."""
    last = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+(?:/[^?#]*?)?/([^/?#]+)/*(?:[?#].*)?$", 1)
    plain = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    return F.when((last == "") | plain.isNull() | (plain.contains("\ufffd") & ~last.contains("\ufffd")), url).otherwise(plain)


def title_from(url: Column) -> Column:
    """The last path segment as words, without its extension; the host if there is none."""
    last = F.regexp_extract(F.regexp_replace(path_of(url), "/+$", ""), "[^/]+$", 0)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))
    return F.when(words == "", host_of(url)).otherwise(words)


def github_repo(url: Column) -> Column:
    return F.nullif(F.regexp_extract(canonical(url, "resolve"), r"^https://github\.com/([^/]+/[^/?#]+)$", 1), F.lit(""))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(canonical(url, "resolve"), r"^https?://youtube\.com/watch\?(?:.*&)?v=([^&]+)", 1), F.lit(""))


def arxiv_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(canonical(url, "resolve"), r"^https?://arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$", 1), F.lit(""))
