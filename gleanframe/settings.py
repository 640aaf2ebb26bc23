"""Settings of discovery and extraction, checked when made."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date
from enum import Enum
from typing import Any
from urllib.parse import quote, urlsplit, urlunsplit


class ScrapingStrategy(str, Enum):
    HEURISTIC = "heuristic"
    GENAI = "genai"
    MARKDOWNIFY = "markdownify"


class LinkExtractionStrategy(str, Enum):
    SHALLOW = "shallow"
    DEEP = "deep"


class OutputFormat(str, Enum):
    MARKDOWN = "markdown"
    JSON = "json"
    XML = "xml"
    XMLTEI = "xmltei"


class ProxyRotationMethod(str, Enum):
    ROUND_ROBIN = "round_robin"
    RANDOM = "random"


#: Names of strategies that were registered beside those above.
OWN_STRATEGIES: set[str] = set()


def _member(kind: type[Enum], value: Any, name: str) -> str:
    try:
        return kind(value).value
    except ValueError:
        raise ValueError(f"{name} must be one of {[m.value for m in kind]}, not {value!r}") from None


@dataclass
class SitemapSettings:
    follow_index: bool = True
    html_fallback: bool = True
    max_depth: int = 3
    max_pages: int = 500
    start_date: date | None = None
    end_date: date | None = None
    strict_date_filter: bool = False
    respect_robots: bool = True
    deduplicate: bool = True


@dataclass
class ProxySettings:
    server: str
    username: str | None = None
    password: str | None = None

    @property
    def url(self) -> str:
        """The server with its credentials, percent-encoded, unless it already has some."""
        if self.username is None or "@" in self.server:
            return self.server
        full = self.server if "://" in self.server else "http://" + self.server
        p = urlsplit(full)
        user = quote(self.username, safe="") + ("" if self.password is None else ":" + quote(self.password, safe=""))
        return urlunsplit((p.scheme, f"{user}@{p.netloc}", p.path, p.query, p.fragment))

    def as_requests_proxies(self) -> dict[str, str]:
        return {"http": self.url, "https": self.url}


@dataclass
class LLMSettings:
    """A model's answers: ``output_schema`` is a StructType or a JSON Schema, ``generate`` gives JSON text for a prompt."""

    output_schema: Any
    generate: Callable[[str, dict], str | None] | None = None
    provider: str | None = None
    model_name: str | None = None
    timeout: float | None = None
    provider_kwargs: dict = field(default_factory=dict)


@dataclass
class Settings:
    sitemap: SitemapSettings = field(default_factory=SitemapSettings)
    link_extraction_strategy: str = "deep"
    link_extraction_limit: int = 50
    include_link_patterns: Sequence[str] | None = None
    exclude_link_patterns: Sequence[str] | None = None
    scraping_strategy: str = "heuristic"
    scraping_output_format: str = "json"
    exclude_selectors: Sequence[str] | None = None
    genai: LLMSettings | None = None
    concurrency: int = 10
    max_retries: int = 2
    request_timeout: float = 10
    retry_delay: float = 1
    proxies: Sequence[ProxySettings] | None = None
    proxy_rotation_method: str = "round_robin"
    logging_level: str | None = None

    def __post_init__(self) -> None:
        self.link_extraction_strategy = _member(LinkExtractionStrategy, self.link_extraction_strategy, "link_extraction_strategy")
        if self.scraping_strategy not in OWN_STRATEGIES:
            self.scraping_strategy = _member(ScrapingStrategy, self.scraping_strategy, "scraping_strategy")
        self.scraping_output_format = _member(OutputFormat, self.scraping_output_format, "scraping_output_format")
        self.proxy_rotation_method = _member(ProxyRotationMethod, self.proxy_rotation_method, "proxy_rotation_method")
        if self.logging_level not in (None, "DEBUG", "INFO", "WARNING", "ERROR"):
            raise ValueError(f"logging_level must be DEBUG, INFO, WARNING, ERROR or None, not {self.logging_level!r}")
        for name, least in (("concurrency", 1), ("max_retries", 1), ("retry_delay", 0), ("link_extraction_limit", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be >= {least}, not {getattr(self, name)}")
        if self.request_timeout <= 0:
            raise ValueError(f"request_timeout must be > 0, not {self.request_timeout}")
        if self.scraping_strategy == "genai":
            if self.scraping_output_format != "json":
                raise ValueError("the genai strategy gives JSON only")
            if self.genai is None:
                raise ValueError("the genai strategy needs genai settings")
