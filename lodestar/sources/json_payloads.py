"""JSON sources: payload text in, items out.

A source is a schema of one result, the place of the results in the payload, and the columns of an item. Payloads that do
not parse give no rows. `ord` is the payload's order and the place within it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import files
from lodestar.schema import items, placed


def c(name: str) -> Column:
    return F.col(f"r.{name}")


def text(*parts) -> Column:
    """Concatenation in which null is empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def either(*options) -> Column:
    """First that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) if isinstance(o, Column) else F.lit(o) for o in options])


def tags(*fixed: str, when: Column | None = None, then: tuple[str, ...] = (), more: Column | None = None) -> Column:
    out = F.array(*[F.lit(t) for t in fixed])
    if when is not None:
        out = F.concat(out, F.when(when, F.array(*[F.lit(t) for t in then])).otherwise(F.array().cast("array<string>")))
    if more is not None:
        out = F.concat(out, F.coalesce(more, F.array().cast("array<string>")))
    return out


def one(value: Column) -> Column:
    """Array of a value, empty if it is null or empty."""
    return F.filter(F.array(value), lambda x: F.coalesce(x, F.lit("")) != "")


def first_names(names: Column, most: int = 3) -> Column:
    return F.nullif(F.array_join(F.slice(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), 1, most), ", "), F.lit(""))


def short(value: Column, most: int = 500) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, most)


def api(direct: Column | bool = False) -> Column:
    both = F.array(F.lit("OFFICIAL_API"), F.lit("DIRECT_LINK"))
    return both if direct is True else F.array(F.lit("OFFICIAL_API")) if direct is False else F.when(direct, both).otherwise(F.array(F.lit("OFFICIAL_API")))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(F.nullif(seconds, F.lit(0).cast("bigint")))


def grouped(number: Column) -> Column:
    return F.format_number(F.coalesce(number, F.lit(0)), 0)


@dataclass(frozen=True)
class Source:
    id: str
    name: str
    schema: str
    rows: str
    columns: Callable[[], dict[str, Column]]
    most: int = 50
    paged: bool = True


SOURCES: dict[str, Source] = {}


def source(id: str, name: str, schema: str, rows: str, most: int = 50, paged: bool = True):
    def put(f):
        SOURCES[id] = Source(id, name, schema, rows, f, most, paged)
        return f

    return put


def parse(payloads: DataFrame, id: str) -> DataFrame:
    """payloads: column payload (JSON text), optionally ord. The rows of a payload keep their order and cap."""
    s = SOURCES[id]
    at = F.col("ord") if "ord" in payloads.columns else F.monotonically_increasing_id()
    rows = F.expr(s.rows.format("j")) if "{" in s.rows else F.col(s.rows)
    # a bare list is read as the first field of the schema
    whole = F.when(F.ltrim("payload").startswith("["), F.concat(F.lit('{"' + s.schema.split()[0] + '":'), F.col("payload"), F.lit("}"))).otherwise(F.col("payload"))
    read = payloads.select(at.alias("__at"), F.from_json(whole, s.schema, {"allowUnquotedControlChars": "true"}).alias("j"))
    flat = read.select("__at", F.posexplode(F.slice(F.filter(rows, lambda r: r.isNotNull()), 1, s.most)).alias("__pos", "r"))
    columns = s.columns()
    keep = columns.pop("keep", None)
    if keep is not None:
        flat = flat.where(keep)
    more = columns.pop("explode", None)
    if more is not None:
        flat = flat.select("__at", (F.col("__pos") * 100).alias("__p"), "r", F.posexplode_outer(more).alias("__k", "e")).withColumn("__pos", F.col("__p") + F.coalesce("__k", F.lit(0)))
    return items(flat, source_id=F.lit(id.split("/")[0]), ord=placed(F.col("__at"), F.col("__pos")), **columns)


# ---------------------------------------------------------------- video


def _video(id: Column, prefix: str, platform: str, page: str, embed: str, **more) -> dict:
    return dict(
        keep=F.coalesce(id, F.lit("")) != "", id=text(prefix + ":", id), canonical_url=text(page, id), platform=F.lit(platform), platform_id=id, embed_url=text(embed, id),
        metadata_sources=api(), raw_metadata=F.create_map(F.lit(prefix + "_item"), F.to_json("r")), **more,
    )


@source("youtube", "YouTube", "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,channelTitle:string,publishedAt:string,thumbnails:struct<high:struct<url:string>,default:struct<url:string>>>>>", "j.items", paged=False)
def _youtube():
    return _video(
        c("id.videoId"), "youtube", "YouTube", "https://www.youtube.com/watch?v=", "https://www.youtube.com/embed/", title=c("snippet.title"), description=c("snippet.description"),
        uploader_name=c("snippet.channelTitle"), publication_date=files.iso_datetime(c("snippet.publishedAt")), thumbnail_url=either(c("snippet.thumbnails.high.url"), c("snippet.thumbnails.default.url")),
    )


@source("youtube/mirror", "YouTube mirrors", "a array<struct<type:string,videoId:string,title:string,description:string,author:string,published:bigint,lengthSeconds:bigint,viewCount:bigint,videoThumbnails:array<struct<url:string>>>>", "j.a")
def _mirror():
    out = _video(
        c("videoId"), "youtube", "YouTube", "https://www.youtube.com/watch?v=", "https://www.youtube.com/embed/", title=c("title"), description=c("description"), uploader_name=c("author"),
        publication_date=epoch(c("published")), duration_seconds=c("lengthSeconds"), view_count=c("viewCount"), thumbnail_url=F.get(c("videoThumbnails.url"), F.lit(0)),
    )
    return out | {"keep": out["keep"] & (c("type") == "video")}


@source("vimeo", "Vimeo", "data array<struct<uri:string,name:string,description:string,user:struct<name:string,link:string>,created_time:string,duration:bigint,tags:array<struct<name:string>>,pictures:struct<sizes:array<struct<link:string>>>>>", "j.data")
def _vimeo():
    return _video(
        F.when(c("uri").contains("/"), F.substring_index(c("uri"), "/", -1)), "vimeo", "Vimeo", "https://vimeo.com/", "https://player.vimeo.com/video/", title=c("name"), description=c("description"),
        uploader_name=c("user.name"), uploader_url=c("user.link"), publication_date=files.iso_datetime(c("created_time")), duration_seconds=c("duration"),
        tags=F.filter(c("tags.name"), lambda t: F.coalesce(t, F.lit("")) != ""), thumbnail_url=F.try_element_at(c("pictures.sizes.link"), F.lit(-1)),
    )


@source("dailymotion", "Dailymotion", "list array<struct<id:string,title:string,description:string,`owner.screenname`:string,`owner.url`:string,created_time:bigint,duration:bigint,tags:array<string>,thumbnail_720_url:string,views_total:bigint,likes_total:bigint>>", "j.list")
def _dailymotion():
    return _video(
        c("id"), "dailymotion", "Dailymotion", "https://www.dailymotion.com/video/", "https://www.dailymotion.com/embed/video/", title=c("title"), description=c("description"),
        uploader_name=c("`owner.screenname`"), uploader_url=c("`owner.url`"), publication_date=epoch(c("created_time")), duration_seconds=c("duration"), tags=c("tags"),
        thumbnail_url=c("thumbnail_720_url"), view_count=c("views_total"), like_count=c("likes_total"),
    )


@source("ia", "Internet Archive", "response struct<docs:array<struct<identifier:string,title:string,description:string,creator:string,publicdate:string,date:string,runtime:string,subject:string,downloads:string>>>", "j.response.docs")
def _archive():
    """creator and subject are a text or a list; as text columns they hold the list's JSON."""
    listed = lambda x: F.from_json(x, "array<string>")
    subjects = F.when(c("subject").startswith("["), listed(c("subject"))).otherwise(F.split(c("subject"), ";"))
    out = _video(
        c("identifier"), "ia", "Internet Archive", "https://archive.org/details/", "https://archive.org/embed/", title=either(c("title"), c("identifier")), description=c("description"),
        uploader_name=F.when(c("creator").startswith("["), F.array_join(listed(c("creator")), ", ")).otherwise(c("creator")),
        publication_date=files.iso_datetime(either(c("publicdate"), c("date"))), duration_seconds=files.runtime(c("runtime")),
        tags=F.filter(F.transform(subjects, lambda t: F.trim(t)), lambda t: t != ""), thumbnail_url=text("https://archive.org/services/img/", c("identifier")),
        view_count=F.when(c("downloads").rlike("^[0-9]+$"), c("downloads").try_cast("bigint")),
    )
    return out


@source("peertube", "PeerTube", "index string, data array<struct<uuid:string,shortUUID:string,url:string,name:string,description:string,channel:struct<displayName:string>,account:struct<displayName:string>,thumbnailPath:string,embedPath:string,publishedAt:string,duration:bigint,tags:array<string>,views:bigint,likes:bigint>>",
        "transform({0}.data, x -> named_struct('i', coalesce({0}.index, 'https://sepiasearch.org'), 'x', x))")
def _peertube():
    x, index = lambda n: c("x." + n), c("i")
    uuid = either(x("uuid"), x("shortUUID"))
    path = lambda p: F.when(p.startswith("/"), F.concat(index, p)).otherwise(p)
    return _video(uuid, "peertube", "PeerTube", "", "") | dict(
        canonical_url=either(x("url"), text(index, "/w/", uuid)), embed_url=path(x("embedPath")), title=x("name"), description=x("description"), uploader_name=either(x("channel.displayName"), x("account.displayName")),
        publication_date=files.iso_datetime(x("publishedAt")), duration_seconds=x("duration"), tags=x("tags"), thumbnail_url=path(x("thumbnailPath")), view_count=x("views"), like_count=x("likes"),
    )


# ---------------------------------------------------------------- software


@source("github", "GitHub", "items array<struct<full_name:string,html_url:string,clone_url:string,description:string,language:string,stargazers_count:bigint,owner:struct<login:string,html_url:string>,created_at:string>>", "j.items", most=15)
def _github():
    name = c("full_name")
    return dict(
        keep=F.coalesce(name, F.lit("")) != "", id=text("github:", name), canonical_url=F.coalesce(c("html_url"), text("https://github.com/", name)), download_url=c("clone_url"), platform=F.lit("GitHub"), platform_id=name,
        title=name, description=short(c("description")), item_type=F.lit("SOFTWARE"), uploader_name=c("owner.login"), uploader_url=c("owner.html_url"), publication_date=files.iso_datetime(c("created_at")),
        view_count=c("stargazers_count"), like_count=c("stargazers_count"), tags=tags("github", "source-code", more=one(F.lower(c("language")))), metadata_sources=api(),
        raw_metadata=F.create_map(F.lit("github_repo"), F.to_json("r")),
    )


@source("github/release", "GitHub releases", "repo string, html_url string, tag_name string, published_at string, author struct<login:string>, assets array<struct<name:string,browser_download_url:string,size:bigint,download_count:bigint>>",
        "transform({0}.assets, x -> named_struct('a', x, 'repo', {0}.repo, 'url', {0}.html_url, 'tag', {0}.tag_name, 'at', {0}.published_at, 'by', {0}.author.login))", most=8)
def _release():
    """repo is put into the payload by whoever fetches the release, as the response lacks it."""
    repo, name, size = c("repo"), c("a.name"), c("a.size")
    ext = files.file_extension(name)
    human = F.when(size > 0, files.format_bytes(size))
    return dict(
        keep=(F.coalesce(name, F.lit("")) != "") & (F.coalesce(c("a.browser_download_url"), F.lit("")) != ""), id=text("github_release:", repo, "/", name), canonical_url=either(c("url"), text("https://github.com/", repo, "/releases")),
        download_url=c("a.browser_download_url"), platform=F.lit("GitHub"), platform_id=text(repo, "@", F.coalesce(c("tag"), F.lit("latest"))), title=text(repo, " — ", name),
        description=text("Release ", c("tag"), " asset: ", name, " (", F.coalesce(human, F.lit("unknown size")), ")"), item_type=files.item_type(ext), file_name=name, file_extension=ext, file_size_bytes=size,
        file_size_human=human, uploader_name=c("by"), publication_date=files.iso_datetime(c("at")), tags=tags("github", "release", "direct-download", more=one(ext)), metadata_sources=api(True),
        raw_metadata=F.create_map(F.lit("repo"), repo, F.lit("tag"), c("tag"), F.lit("asset"), name, F.lit("downloads"), c("a.download_count").cast("string")),
    )


def _hub(kind: str, prefix: str, path: str, item_type: str, description: Column, tag: Column) -> dict:
    name = c("id")
    return dict(
        keep=F.coalesce(name, F.lit("")) != "", id=text(prefix, ":", name), canonical_url=text("https://huggingface.co/", path, name), download_url=text("https://huggingface.co/", path, name, "/resolve/main/README.md"),
        platform=F.lit("HuggingFace"), platform_id=name, title=name, description=description, item_type=F.lit(item_type), uploader_name=F.when(name.contains("/"), F.substring_index(name, "/", 1)),
        publication_date=files.iso_datetime(either(c("createdAt"), c("lastModified"))), view_count=c("downloads"), like_count=c("likes"), tags=tag, metadata_sources=api(), raw_metadata=F.create_map(F.lit(prefix), F.to_json("r")),
    )


_HUB = "a array<struct<id:string,downloads:bigint,likes:bigint,pipeline_tag:string,createdAt:string,lastModified:string,tags:array<string>>>"


@source("huggingface", "HuggingFace models", _HUB, "j.a", most=20, paged=False)
def _models():
    return _hub("model", "hf_model", "", "SOFTWARE", text("ML model (", either(c("pipeline_tag"), "general"), ") — ", grouped(c("downloads")), " downloads, ", grouped(c("likes")), " likes"),
                tags("huggingface", "model", "ai-weights", more=one(c("pipeline_tag"))))


@source("huggingface/datasets", "HuggingFace datasets", _HUB, "j.a", most=15, paged=False)
def _datasets():
    return _hub("dataset", "hf_dataset", "datasets/", "DATASET", text("Dataset — ", grouped(c("downloads")), " downloads, ", grouped(c("likes")), " likes"), tags("huggingface", "dataset", "ai-data"))


def _package(name: Column, prefix: str, platform: str, **more) -> dict:
    return dict(keep=F.coalesce(name, F.lit("")) != "", id=text(prefix + ":", name), platform=F.lit(platform), platform_id=name, item_type=F.lit("SOFTWARE"), raw_metadata=F.create_map(F.lit(prefix), F.to_json("r"))) | more


@source("registries/npm", "npm", "objects array<struct<package:struct<name:string,version:string,description:string,links:struct<npm:string>,publisher:struct<username:string>,author:struct<name:string>>>>", "j.objects", most=15, paged=False)
def _npm():
    name, version = c("package.name"), c("package.version")
    return _package(
        name, "npm", "npm", canonical_url=either(c("package.links.npm"), text("https://www.npmjs.com/package/", name)), title=text(name, " (", version, ")"), description=short(c("package.description"), 300),
        download_url=text("https://registry.npmjs.org/", name, "/-/", F.substring_index(name, "/", -1), "-", version, ".tgz"), file_name=text(name, "-", version, ".tgz"), file_extension=F.lit("tgz"),
        uploader_name=F.when(c("package.publisher").isNotNull(), c("package.publisher.username")).otherwise(c("package.author.name")), tags=tags("npm", "package", "javascript", "direct-download"), metadata_sources=api(True),
    )


@source("registries/crates", "crates.io", "crates array<struct<name:string,description:string,downloads:bigint,recent_downloads:bigint,max_stable_version:string,newest_version:string,updated_at:string>>", "j.crates", most=15, paged=False)
def _crates():
    name, version = c("name"), either(c("max_stable_version"), c("newest_version"))
    has = version.isNotNull()
    return _package(
        name, "crate", "crates.io", canonical_url=text("https://crates.io/crates/", name), download_url=F.when(has, text("https://crates.io/api/v1/crates/", name, "/", version, "/download")),
        title=F.when(has, text(name, " (", version, ")")).otherwise(name), description=short(c("description"), 300), file_name=F.when(has, text(name, "-", version, ".crate")), file_extension=F.when(has, "crate"),
        view_count=c("downloads"), like_count=c("recent_downloads"), tags=tags("crate", "rust", "package", when=has, then=("direct-download",)), metadata_sources=api(has),
    )


@source("registries/rubygems", "RubyGems", "a array<struct<name:string,version:string,info:string,authors:string,project_uri:string,gem_uri:string,downloads:bigint>>", "j.a", most=15, paged=False)
def _gems():
    name, version, has = c("name"), F.nullif(c("version"), F.lit("")), F.coalesce(c("gem_uri"), F.lit("")) != ""
    return _package(
        name, "rubygem", "RubyGems", canonical_url=either(c("project_uri"), text("https://rubygems.org/gems/", name)), download_url=c("gem_uri"), title=F.when(version.isNotNull(), text(name, " (", version, ")")).otherwise(name),
        description=short(c("info"), 300), file_name=F.when(has & version.isNotNull(), text(name, "-", version, ".gem")), file_extension=F.when(has, "gem"), uploader_name=c("authors"), view_count=c("downloads"),
        tags=tags("ruby", "gem", "package", when=has, then=("direct-download",)), metadata_sources=api(has),
    )


@source("registries/packagist", "Packagist", "results array<struct<name:string,description:string,url:string,downloads:bigint,favers:bigint>>", "j.results", most=15, paged=False)
def _packagist():
    return _package(
        c("name"), "packagist", "Packagist", canonical_url=either(c("url"), text("https://packagist.org/packages/", c("name"))), title=c("name"), description=short(c("description"), 300), view_count=c("downloads"),
        like_count=c("favers"), tags=tags("php", "composer", "package"), metadata_sources=api(),
    )


@source("registries/nuget", "NuGet", "data array<struct<id:string,version:string,title:string,description:string,authors:array<string>,totalDownloads:bigint,verified:boolean>>", "j.data", most=15, paged=False)
def _nuget():
    name, version = c("id"), F.nullif(c("version"), F.lit(""))
    has = version.isNotNull()
    low, v = F.lower(name), version
    return _package(
        name, "nuget", "NuGet", canonical_url=text("https://www.nuget.org/packages/", name, "/"), download_url=F.when(has, text("https://api.nuget.org/v3-flatcontainer/", low, "/", v, "/", low, ".", v, ".nupkg")),
        title=F.when(has, text(either(c("title"), name), " (", version, ")")).otherwise(name), description=short(c("description"), 300), file_name=F.when(has, text(name, ".", version, ".nupkg")), file_extension=F.when(has, "nupkg"),
        uploader_name=first_names(c("authors")), view_count=c("totalDownloads"), tags=tags("dotnet", "nuget", "package", when=has, then=("direct-download",)), metadata_sources=api(has),
    )


@source("registries/aur", "AUR", "results array<struct<ID:bigint,Name:string,Version:string,Description:string,URLPath:string,NumVotes:bigint,Maintainer:string,Popularity:double>>", "j.results", most=15, paged=False)
def _aur():
    name, has = c("Name"), F.coalesce(c("URLPath"), F.lit("")) != ""
    return _package(
        name, "aur", "AUR", canonical_url=text("https://aur.archlinux.org/packages/", name), download_url=F.when(has, text("https://aur.archlinux.org", c("URLPath"))), title=F.trim(text(name, " ", c("Version"))),
        description=short(c("Description"), 300), file_name=F.when(has, text(name, ".tar.gz")), file_extension=F.when(has, "tar.gz"), uploader_name=c("Maintainer"), like_count=c("NumVotes"),
        tags=tags("arch-linux", "aur", "package", when=has, then=("direct-download",)), metadata_sources=api(has),
    )


@source("registries/dockerhub", "Docker Hub", "results array<struct<repo_name:string,short_description:string,star_count:bigint,pull_count:bigint,is_official:boolean>>", "j.results", most=15, paged=False)
def _docker():
    name = c("repo_name")
    full = F.when(name.contains("/"), name).otherwise(text("library/", name))
    return _package(
        full, "dockerhub", "Docker Hub", canonical_url=text("https://hub.docker.com/r/", full), title=name, description=short(c("short_description"), 300), like_count=c("star_count"), view_count=c("pull_count"),
        tags=tags("docker", "container", "image"), metadata_sources=api(),
    ) | {"keep": F.coalesce(name, F.lit("")) != ""}


@source("gitlab", "GitLab", "a array<struct<path_with_namespace:string,web_url:string,http_url_to_repo:string,description:string,star_count:bigint,topics:array<string>,created_at:string,namespace:struct<path:string>>>", "j.a", most=15)
def _gitlab():
    path = c("path_with_namespace")
    return _package(
        path, "gitlab", "GitLab", canonical_url=F.coalesce(c("web_url"), text("https://gitlab.com/", path)), download_url=c("http_url_to_repo"), title=path, description=short(c("description")), uploader_name=c("namespace.path"),
        publication_date=files.iso_datetime(c("created_at")), view_count=c("star_count"), like_count=c("star_count"), tags=tags("gitlab", "source-code", more=F.transform(F.slice(c("topics"), 1, 5), F.lower)), metadata_sources=api(),
    )


@source("codeberg", "Codeberg", "data array<struct<full_name:string,html_url:string,clone_url:string,description:string,stars_count:bigint,created_at:string,language:string,owner:struct<username:string>>>", "j.data", most=15)
def _codeberg():
    name = c("full_name")
    return _package(
        name, "codeberg", "Codeberg", canonical_url=F.coalesce(c("html_url"), text("https://codeberg.org/", name)), download_url=c("clone_url"), title=name, description=short(c("description")), uploader_name=c("owner.username"),
        publication_date=files.iso_datetime(c("created_at")), view_count=c("stars_count"), like_count=c("stars_count"), tags=tags("codeberg", "source-code", more=one(F.lower(c("language")))), metadata_sources=api(),
    )


@source("modrinth", "Modrinth", "hits array<struct<project_id:string,project_type:string,slug:string,author:string,title:string,description:string,categories:array<string>,downloads:bigint,follows:bigint,icon_url:string,date_created:string>>", "j.hits", most=15)
def _modrinth():
    slug, kind = either(c("slug"), c("project_id")), F.coalesce(c("project_type"), F.lit("mod"))
    return _package(
        slug, "modrinth", "Modrinth", canonical_url=text("https://modrinth.com/", kind, "/", slug), title=either(c("title"), slug), description=short(c("description"), 300), uploader_name=c("author"),
        publication_date=files.iso_datetime(c("date_created")), view_count=c("downloads"), like_count=c("follows"), thumbnail_url=c("icon_url"),
        tags=F.concat(F.array(F.lit("minecraft"), kind), F.coalesce(F.transform(F.slice(c("categories"), 1, 5), F.lower), F.array().cast("array<string>"))), metadata_sources=api(),
    )


# ---------------------------------------------------------------- papers, books, media


@source("zenodo", "Zenodo", "hits struct<hits:array<struct<id:bigint,created:string,doi:string,metadata:struct<title:string,description:string>,files:array<struct<key:string,size:bigint,links:struct<self:string,download:string>>>>>>", "j.hits.hits", most=15)
def _zenodo():
    """One row for each of the first six files, or one document without any."""
    rec, key, size = c("id"), F.coalesce(F.col("e.key"), F.lit("file")), F.col("e.size")
    has = F.col("e").isNotNull()
    title = either(c("metadata.title"), text("Zenodo record ", rec))
    ext = files.file_extension(key)
    return dict(
        keep=rec.isNotNull(), explode=F.slice(c("files"), 1, 6), id=F.when(has, text("zenodo:", rec, "/", key)).otherwise(text("zenodo:", rec)), canonical_url=text("https://zenodo.org/records/", rec),
        download_url=F.when(has, either(F.col("e.links.self"), F.col("e.links.download"))), platform=F.lit("Zenodo"), platform_id=rec.cast("string"), title=F.when(has, text(title, " — ", key)).otherwise(title),
        description=either(F.regexp_replace(short(c("metadata.description")), "<[^>]+>", " "), text("Zenodo research record ", rec)), item_type=F.when(has, files.item_type(ext)).otherwise("DOCUMENT"), file_name=F.when(has, key),
        file_extension=F.when(has, ext), file_size_bytes=size, file_size_human=F.when(size > 0, files.format_bytes(size)), publication_date=files.iso_datetime(c("created")),
        tags=tags("zenodo", "research", when=has, then=("direct-download",), more=F.when(has, one(ext))), metadata_sources=api(has), raw_metadata=F.create_map(F.lit("zenodo_record"), rec.cast("string"), F.lit("doi"), c("doi")),
    )


def _paper(id: Column, prefix: str, platform: str, own: Column, **more) -> dict:
    return dict(keep=F.coalesce(own, F.lit("")) != "", id=id, platform=F.lit(platform), platform_id=own, item_type=F.lit("DOCUMENT"), raw_metadata=F.create_map(F.lit(prefix), F.to_json("r"))) | more


@source("europepmc", "Europe PMC", "resultList struct<result:array<struct<id:string,source:string,doi:string,title:string,authorString:string,abstractText:string,pubYear:string,isOpenAccess:string,inPMC:string,pmcid:string,firstPublicationDate:string,citedByCount:bigint>>>", "j.resultList.result", most=15)
def _europepmc():
    origin = F.coalesce(c("source"), F.lit("MED"))
    full = F.when(((c("inPMC") == "Y") | (c("isOpenAccess") == "Y")) & (F.coalesce(c("pmcid"), F.lit("")) != ""), text("https://europepmc.org/article/", origin, "/", c("pmcid")))
    return _paper(
        text("europepmc:", origin, ":", c("id")), "europepmc", "Europe PMC", c("id"), canonical_url=text("https://europepmc.org/article/", origin, "/", c("id")), download_url=full, title=either(c("title"), text("Europe PMC ", c("id"))),
        description=short(c("abstractText")), uploader_name=c("authorString"), publication_date=files.iso_datetime(c("firstPublicationDate")), tags=tags("paper", "biomedical", "europepmc", when=full.isNotNull(), then=("open-access",)), metadata_sources=api(),
    )


@source("doaj", "DOAJ", "results array<struct<id:string,bibjson:struct<title:string,abstract:string,year:string,month:string,author:array<struct<name:string>>,keywords:array<string>,journal:struct<title:string>,identifier:array<struct<id:string,type:string>>,link:array<struct<type:string,url:string>>>>>", "j.results", most=15)
def _doaj():
    b = lambda n: c("bibjson." + n)
    full = F.get(F.filter(b("link"), lambda x: (x["type"] == "fulltext") & (F.coalesce(x["url"], F.lit("")) != "")), F.lit(0))["url"]
    return _paper(
        text("doaj:", c("id")), "doaj", "DOAJ", c("id"), canonical_url=F.coalesce(full, text("https://doaj.org/article/", c("id"))), download_url=full, title=either(b("title"), text("DOAJ article ", c("id"))), description=short(b("abstract")),
        uploader_name=F.coalesce(first_names(b("author.name")), b("journal.title"), F.lit("")), publication_date=files.date_of(b("year"), F.nullif(b("month"), F.lit(""))),
        tags=tags("paper", "open-access", "journal", more=F.transform(F.slice(b("keywords"), 1, 8), F.lower)), metadata_sources=api(full.isNotNull()),
    )


@source("crossref", "Crossref", "message struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,issued:struct<`date-parts`:array<array<int>>>,`is-referenced-by-count`:bigint,type:string,publisher:string,abstract:string,resource:struct<primary:struct<URL:string>>>>>", "j.message.items", most=15)
def _crossref():
    journal = F.coalesce(F.get(c("`container-title`"), F.lit(0)), F.lit(""))
    people = F.transform(F.slice(c("author"), 1, 3), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    date = F.get(c("issued.`date-parts`"), F.lit(0))
    part = lambda k: F.get(date, F.lit(k)).cast("string")
    return _paper(
        text("crossref:", c("DOI")), "crossref", "Crossref", c("DOI"), canonical_url=either(c("resource.primary.URL"), text("https://doi.org/", c("DOI"))), title=F.coalesce(F.get(c("title"), F.lit(0)), text("Crossref ", c("DOI"))),
        description=short(either(c("abstract"), journal)), uploader_name=F.coalesce(first_names(people), journal), publication_date=files.date_of(part(0), part(1), part(2)), like_count=c("`is-referenced-by-count`"),
        tags=tags("paper", "doi", "scholarly"), metadata_sources=api(),
    )


@source("semanticscholar", "Semantic Scholar", "data array<struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,abstract:string,citationCount:bigint,url:string,externalIds:struct<DOI:string>,openAccessPdf:struct<url:string>>>", "j.data", most=15)
def _semantic():
    own, pdf = either(c("paperId"), c("externalIds.DOI")), F.nullif(c("openAccessPdf.url"), F.lit(""))
    return _paper(
        text("semanticscholar:", own), "semanticscholar", "Semantic Scholar", own, canonical_url=either(c("url"), text("https://www.semanticscholar.org/paper/", own)), download_url=pdf, title=either(c("title"), text("Paper ", own)),
        description=short(c("abstract")), uploader_name=first_names(F.slice(c("authors.name"), 1, 3)), publication_date=files.date_of(c("year").cast("string")), like_count=c("citationCount"),
        tags=tags("paper", "ai-research", when=pdf.isNotNull(), then=("open-access", "pdf", "direct-download")), metadata_sources=api(pdf.isNotNull()),
    )


@source("openlibrary", "Open Library", "docs array<struct<title:string,author_name:array<string>,key:string,ia:array<string>,ebook_access:string,first_publish_year:int,cover_i:bigint>>", "j.docs", most=20)
def _books():
    public = F.coalesce(c("ebook_access"), F.lit("no_ebook")) == "public"
    scan = F.get(c("ia"), F.lit(0))
    pdf = F.when(public & scan.isNotNull(), text("https://archive.org/download/", scan, "/", scan, ".pdf"))
    people = first_names(c("author_name"))
    return _paper(
        text("ol:", c("key")), "ol_doc", "OpenLibrary", c("key"), canonical_url=text("https://openlibrary.org", c("key")), download_url=pdf, title=F.coalesce(c("title"), F.lit("Untitled")),
        description=text("Book by ", F.coalesce(people, F.lit("unknown")), " (", F.coalesce(c("first_publish_year").cast("string"), F.lit("?")), ")", F.when(public, " — public ebook available")), file_extension=F.when(pdf.isNotNull(), "pdf"),
        uploader_name=people, thumbnail_url=F.when(c("cover_i") > 0, text("https://covers.openlibrary.org/b/id/", c("cover_i"), "-M.jpg")), tags=tags("book", "openlibrary", when=pdf.isNotNull(), then=("ebook", "direct-download")), metadata_sources=api(pdf.isNotNull()),
    )


@source("commons", "Wikimedia Commons", "query struct<pages:map<string,struct<pageid:bigint,title:string,imageinfo:array<struct<url:string,descriptionurl:string,thumburl:string,size:bigint,mime:string,width:int,height:int>>>>>", "map_values({0}.query.pages)", most=20)
def _commons():
    info = F.get(c("imageinfo"), F.lit(0))
    mime, size, link = F.coalesce(info["mime"], F.lit("")), info["size"], F.substring_index(info["url"], "?", 1)
    plain = F.replace(F.coalesce(c("title"), F.lit("")), F.lit("File:"), F.lit(""))
    name = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    kind = F.when(mime.startswith("audio/"), "AUDIO").when(mime.startswith("video/"), "VIDEO").when(mime.startswith("image/"), "IMAGE").when(mime.contains("pdf"), "DOCUMENT").otherwise("FILE")
    human = F.when(size > 0, files.format_bytes(size))
    return dict(
        keep=F.coalesce(info["url"], F.lit("")) != "", id=text("commons:", F.coalesce(c("pageid").cast("string"), plain)), canonical_url=either(info["descriptionurl"], link), download_url=link, platform=F.lit("Wikimedia Commons"),
        platform_id=F.coalesce(c("pageid").cast("string"), F.lit("")), title=name, description=text("Freely licensed media file (", mime, ", ", F.coalesce(human, F.lit("unknown size")), ")"), item_type=kind, file_name=name,
        file_extension=files.file_extension(link), file_size_bytes=size, file_size_human=human, thumbnail_url=either(info["thumburl"], F.when(mime.startswith("image/"), link)),
        tags=tags("commons", "wikimedia", "free-license", "direct-download"), metadata_sources=api(True), raw_metadata=F.create_map(F.lit("commons_file"), F.to_json("r")),
    )


def _open_media(kind: str) -> dict:
    has = F.coalesce(c("license"), F.lit("")) != ""
    return dict(
        keep=(F.coalesce(c("id"), F.lit("")) != "") & (F.coalesce(c("url"), F.lit("")) != ""), id=text(f"openverse_{kind}:", c("id")), canonical_url=either(c("foreign_landing_url"), c("url")), download_url=c("url"), platform=F.lit("Openverse"), platform_id=c("id"),
        title=either(c("title"), text(f"Openverse {kind} ", c("id"))), description=text(f"CC-licensed {kind} by ", either(c("creator"), "unknown"), " on ", either(c("provider"), c("source"), "Openverse"), " (", c("license"), " license)"),
        item_type=F.lit(kind.upper()), file_extension=F.lit("mp3") if kind == "audio" else F.lit(None), uploader_name=c("creator"), duration_seconds=c("duration") if kind == "audio" else F.lit(None),
        thumbnail_url=either(c("thumbnail"), c("url")) if kind == "image" else c("thumbnail"), tags=tags("openverse", "creative-commons", kind, more=F.when(has, F.array(F.lower(c("license"))))), metadata_sources=api(True),
        raw_metadata=F.create_map(F.lit("openverse"), F.to_json("r")),
    )


_OPEN = "results array<struct<id:string,title:string,url:string,creator:string,license:string,provider:string,source:string,foreign_landing_url:string,thumbnail:string,duration:bigint>>"
source("openverse", "Openverse images", _OPEN, "j.results", most=20)(lambda: _open_media("image"))
source("openverse/audio", "Openverse audio", _OPEN, "j.results", most=15)(lambda: _open_media("audio"))


def _itunes(media: str) -> dict:
    own, kind = F.coalesce(c("trackId"), c("collectionId")), F.coalesce(c("kind"), F.lit(""))
    movie = kind.contains("movie") & ~kind.contains("song") if media != "music" else F.lit(False)
    art = F.replace(either(c("artworkUrl100"), c("artworkUrl60")), F.lit("100x100"), F.lit("300x300"))
    return dict(
        keep=own.isNotNull(), id=text("itunes:", own), canonical_url=either(c("trackViewUrl"), c("collectionViewUrl"), "https://music.apple.com"), download_url=c("previewUrl"), platform=F.lit("iTunes"), platform_id=own.cast("string"),
        title=either(c("trackName"), c("collectionName"), text("iTunes ", own)), description=F.regexp_replace(text(c("artistName"), " — ", c("collectionName")), "^[ —]+|[ —]+$", ""), item_type=F.when(movie, "VIDEO").otherwise("AUDIO"),
        uploader_name=c("artistName"), publication_date=files.iso_datetime(c("releaseDate")), duration_seconds=F.nullif(F.expr("r.trackTimeMillis div 1000"), F.lit(0).cast("bigint")), thumbnail_url=art, embed_url=c("previewUrl"),
        tags=tags("music" if media == "music" else "podcast", "itunes", "apple"), metadata_sources=api(), raw_metadata=F.create_map(F.lit("itunes"), F.to_json("r")),
    )


_ITUNES = "results array<struct<trackId:bigint,collectionId:bigint,trackName:string,artistName:string,collectionName:string,trackViewUrl:string,collectionViewUrl:string,previewUrl:string,artworkUrl100:string,artworkUrl60:string,releaseDate:string,trackTimeMillis:bigint,kind:string,primaryGenreName:string>>"
source("itunes", "iTunes music", _ITUNES, "j.results", most=12, paged=False)(lambda: _itunes("music"))
source("itunes/podcast", "iTunes podcasts", _ITUNES, "j.results", most=12, paged=False)(lambda: _itunes("podcast"))


@source("mixcloud", "Mixcloud", "data array<struct<key:string,url:string,name:string,tags:array<struct<name:string>>,created_time:string,audio_length:bigint,play_count:bigint,favorite_count:bigint,listener_count:bigint,pictures:struct<medium:string,thumbnail:string>,user:struct<name:string,url:string>>>", "j.data", most=15)
def _mixcloud():
    key = F.regexp_replace(F.coalesce(c("key"), F.lit("")), "^/+|/+$", "")
    named = F.filter(F.slice(c("tags.name"), 1, 6), lambda t: F.coalesce(t, F.lit("")) != "")
    return dict(
        keep=key != "", id=text("mixcloud:", key), canonical_url=either(c("url"), text("https://www.mixcloud.com/", key)), platform=F.lit("Mixcloud"), platform_id=key, title=either(c("name"), F.substring_index(key, "/", -1)),
        description=text("DJ mix / radio show by ", F.coalesce(c("user.name"), F.lit("unknown"))), item_type=F.lit("AUDIO"), uploader_name=c("user.name"), uploader_url=c("user.url"), publication_date=files.iso_datetime(c("created_time")),
        duration_seconds=c("audio_length"), view_count=c("play_count"), like_count=c("favorite_count"), thumbnail_url=either(c("pictures.medium"), c("pictures.thumbnail")), embed_url=text("https://www.mixcloud.com/widget/iframe/?feed=", key),
        tags=tags("mix", "dj", "mixcloud", more=F.transform(named, F.lower)), metadata_sources=api(), raw_metadata=F.create_map(F.lit("mixcloud"), F.to_json("r")),
    )


# ---------------------------------------------------------------- communities


@source("hackernews", "Hacker News", "hits array<struct<objectID:string,title:string,story_title:string,url:string,author:string,points:bigint,num_comments:bigint,created_at:string>>", "j.hits", most=15)
def _news():
    own, zero = c("objectID"), F.lit(0)
    return dict(
        keep=F.coalesce(own, F.lit("")) != "", id=text("hn:", own), canonical_url=text("https://news.ycombinator.com/item?id=", own), platform=F.lit("Hacker News"), platform_id=own, title=either(c("title"), c("story_title"), text("HN item ", own)),
        description=text("HN discussion (", F.coalesce(c("points"), zero), " points, ", F.coalesce(c("num_comments"), zero), " comments)", F.when(F.coalesce(c("url"), F.lit("")) != "", text(" — links to ", c("url")))), item_type=F.lit("WEB_PAGE"),
        uploader_name=c("author"), publication_date=files.iso_datetime(c("created_at")), view_count=c("points"), like_count=c("num_comments"), embed_url=c("url"), tags=tags("discussion", "hackernews", "tech"), metadata_sources=api(),
        raw_metadata=F.create_map(F.lit("points"), c("points").cast("string"), F.lit("num_comments"), c("num_comments").cast("string")),
    )


@source("stackexchange", "StackExchange", "site string, items array<struct<question_id:bigint,title:string,link:string,tags:array<string>,is_answered:boolean,view_count:bigint,score:bigint,answer_count:bigint,creation_date:bigint,owner:struct<display_name:string,link:string>>>",
        "transform({0}.items, x -> named_struct('site', coalesce({0}.site, 'stackoverflow'), 'x', x))", most=8)
def _stack():
    x, own, zero = lambda n: c("x." + n), c("x.question_id"), F.lit(0)
    return dict(
        keep=own.isNotNull(), id=text("stackex:", c("site"), ":", own), canonical_url=either(x("link"), text("https://", c("site"), ".com/questions/", own)), platform=text("StackExchange (", c("site"), ")"), platform_id=own.cast("string"),
        title=either(x("title"), text("Question ", own)), description=text(F.coalesce(x("answer_count"), zero), " answers · ", F.coalesce(x("score"), zero), " score · ", F.when(x("is_answered"), "answered ✓").otherwise("unanswered")), item_type=F.lit("WEB_PAGE"),
        uploader_name=x("owner.display_name"), uploader_url=x("owner.link"), publication_date=epoch(x("creation_date")), view_count=x("view_count"), like_count=x("score"),
        tags=F.concat(F.array(F.lit("question"), F.lit("qa"), c("site")), F.coalesce(F.transform(F.slice(x("tags"), 1, 6), F.lower), F.array().cast("array<string>"))),
        metadata_sources=api(), raw_metadata=F.create_map(F.lit("stackexchange"), F.to_json("r")),
    )


# ---------------------------------------------------------------- search engines


def _place(payloads: DataFrame) -> Column:
    return (F.col("ord") if "ord" in payloads.columns else F.monotonically_increasing_id()).alias("__at")


def opensearch_hits(payloads: DataFrame, *more: str) -> DataFrame:
    """url, title, snippet (and ord, if asked for) of an OpenSearch reply: [query, titles, descriptions, urls]."""
    j = F.from_json("payload", "array<string>")
    part = lambda k: F.from_json(F.get(j, F.lit(k)), "array<string>")
    zipped = F.arrays_zip(part(3).alias("url"), part(1).alias("title"), part(2).alias("snippet"))
    rows = payloads.select(_place(payloads), F.posexplode(zipped).alias("__pos", "h"))
    return rows.select("h.url", "h.title", "h.snippet", placed(F.col("__at"), F.col("__pos")).alias("ord")).where("url <> ''").select("url", "title", "snippet", *more)


def searxng_hits(payloads: DataFrame, *more: str) -> DataFrame:
    """url, title, snippet (and ord, if asked for) of a SearXNG reply."""
    j = F.from_json("payload", "results array<struct<url:string,title:string,content:string>>")
    rows = payloads.select(_place(payloads), F.posexplode(j["results"]).alias("__pos", "h"))
    return rows.select("h.url", "h.title", F.col("h.content").alias("snippet"), placed(F.col("__at"), F.col("__pos")).alias("ord")).where("url <> ''").select("url", "title", "snippet", *more)
