"""Who and why: metadata structs from request headers and context, and their sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.canon import strip_nul
from palimpsest.model import METADATA

REDACTED = "[REDACTED]"
# Parts of custom keys whose values must not be kept.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "private_key", "privatekey", "auth")
# Request headers.
HTTP = {"actor_id": "X-Actor-ID", "actor_type": "X-Actor-Type", "reason": "X-Audit-Reason", "correlation_id": "X-Correlation-ID", "request_id": "X-Request-ID", "traceparent": "Traceparent"}
GRPC = {"actor_id": "x-actor-id", "actor_type": "x-actor-type", "reason": "x-audit-reason", "correlation_id": "x-correlation-id", "request_id": "x-request-id", "trace_id": "x-trace-id", "span_id": "x-span-id"}


def sanitize(custom: Column) -> Column:
    """Values of sensitive keys (any letter case) replaced; null stays null."""
    return F.transform_values(custom, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), F.lit(REDACTED)).otherwise(v))


def trace_id(traceparent: Column) -> Column:
    """Characters 4 to 35 of a traceparent of at least 55, else ''."""
    return F.when(F.length(traceparent) >= 55, F.substring(traceparent, 4, 32)).otherwise("")


def span_id(traceparent: Column) -> Column:
    return F.when(F.length(traceparent) >= 55, F.substring(traceparent, 37, 16)).otherwise("")


def actor_type(name: Column) -> Column:
    """human, service or system; anything else is human."""
    return F.when(name.isin("human", "service", "system"), name).otherwise("human")


def _set(**fields: Column) -> Column:
    none = {f.name: F.lit(None).cast(f.dataType) for f in METADATA.fields}
    return F.struct(*[(fields.get(n, c)).cast(METADATA[n].dataType).alias(n) for n, c in none.items()])


def from_http(headers: Column, at: Column | None = None) -> Column:
    """Metadata from a map of HTTP headers (names in any letter case)."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    h = lambda n: F.coalesce(F.element_at(lowered, HTTP[n].lower()), F.lit(""))
    correlation = F.coalesce(F.nullif(h("correlation_id"), F.lit("")), h("request_id"))
    return _set(actor_id=h("actor_id"), actor_type=actor_type(h("actor_type")), reason=h("reason"), correlation_id=correlation, trace_id=trace_id(h("traceparent")), span_id=span_id(h("traceparent")), source=F.lit("http"), **({"timestamp": at} if at is not None else {}))


def from_grpc(pairs: Column, at: Column | None = None) -> Column:
    """Metadata from a map of gRPC keys to lists of values; the first value counts."""
    g = lambda n: F.coalesce(F.get(F.element_at(pairs, GRPC[n]), F.lit(0)), F.lit(""))
    correlation = F.coalesce(F.nullif(g("correlation_id"), F.lit("")), g("request_id"))
    return _set(actor_id=g("actor_id"), actor_type=actor_type(g("actor_type")), reason=g("reason"), correlation_id=correlation, trace_id=g("trace_id"), span_id=g("span_id"), source=F.lit("grpc"), **({"timestamp": at} if at is not None else {}))


class Context:
    """Literal metadata for a batch; each setter returns a new context, custom entries add up and the last wins."""

    def __init__(self, **values) -> None:
        self.values = values

    def _with(self, **values) -> Context:
        return Context(**(self.values | values))

    def actor(self, actor_id: str, kind: str = "human") -> Context:
        return self._with(actor_id=actor_id, actor_type=kind)

    def reason(self, text: str) -> Context:
        return self._with(reason=text)

    def correlation(self, text: str) -> Context:
        return self._with(correlation_id=text)

    def custom(self, **entries: str) -> Context:
        return self._with(custom=self.values.get("custom", {}) | entries)

    def tenant(self, tenant_id: str) -> Context:
        """Scopes reads, and stamps what is written with it."""
        return self._with(tenant=tenant_id).custom(tenant_id=tenant_id)

    def metadata(self, at: Column | None = None) -> Column:
        v = {k: strip_nul(F.lit(x)) for k, x in self.values.items() if k not in ("custom", "tenant")}
        if custom := self.values.get("custom"):
            v["custom"] = F.create_map(*[strip_nul(F.lit(x)) for pair in sorted(custom.items()) for x in pair])
        return _set(**v, **({"timestamp": at} if at is not None else {}))
