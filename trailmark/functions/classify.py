"""What a request is: script, asset, preflight, route or endpoint; and whether it is a scanner's probe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path and name patterns.
API_HINT = r"(?i)/(api|v\d+|graphql|rest|gql)(/|$)"
PRIVILEGED = r"(?i)/(admin|administrator|internal|manage|management|config|privileged|superuser|staff|root|debug|actuator|console|backoffice|ops)(/|$)"
TELEMETRY = r"(?i)/(collect|track|tracking|trackevents?|beacon|pixel|analytics|telemetry|gtag|gtm|ping|rum|csp-report)(/|$)"
STATIC = r"(?i)\.(?:png|jpe?g|gif|svg|ico|webp|avif|bmp|css|woff2?|ttf|otf|eot|map|mp4|webm|mp3|wav|pdf|zip)$"
STATIC_MIMES = ["css", "image", "gif", "jpeg", "png", "svg", "font", "woff", "woff2", "ico"]
PROBE_METHODS = ["TRACE", "DEBUG", "TRACK"]
PROBE = (
    r"(?i)(?:\.\.[/\\]|\.\.%2f|\.\.%5c|%2e%2e|%252e|%00|%c0%ae|%c0%af|%0d%0a|%0a[a-z0-9]|\\x00|%2a%7e1|\*~1|~1[/\\]|%25%7b|%24%7b|\$\{|%23_?member|ognl|jndi:"
    r"|%3cscript|<script|union(?:%20|\+|\s)select|\.(?:js|css|png|jpe?g|svg|ico|woff2?|map)/)"
)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_script(mime: Column, template: Column) -> Column:
    return _yes(F.lower(mime).contains("script")) | _yes(template.rlike(r"\.m?js$"))


def is_html(mime: Column) -> Column:
    return _yes(F.lower(mime).contains("html"))


def is_api(mime: Column, template: Column) -> Column:
    low = F.lower(mime)
    return _yes(template.rlike(API_HINT)) | _yes(low.contains("json") | (low == "xml"))


def is_probe(method: Column, path: Column) -> Column:
    return _yes(method.isin(PROBE_METHODS)) | _yes(path.rlike(PROBE))


def row_class(method: Column, template: Column, mime: Column, status: Column, n_query: Column, preflight: Column) -> Column:
    read = method.isin("GET", "HEAD")
    static = _yes(template.rlike(STATIC)) | _yes(F.lower(mime).isin(STATIC_MIMES))
    redirect = _yes((status >= 300) & (status < 400))
    return (
        F.when(_yes(preflight), "preflight")
        .when(is_script(mime, template), "script")
        .when(static & read, "asset")
        .when(~read, "endpoint")
        .when(is_html(mime), "route")
        .when(is_api(mime, template) | (_yes(n_query > 0) & ~redirect), "endpoint")
        .otherwise("route")
    )
