"""The build: items and documents to candidate edges, merged edges and works outside."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from litmesh.operators import edges as E
from litmesh.operators import items as I
from litmesh.operators import resolve as X
from litmesh.session import stage


@dataclass(frozen=True)
class Provider:
    """A strategy: `derive(context)` gives candidate edges."""

    id: str
    label: str
    derive: Callable[[Context], DataFrame]
    requires_network: bool = False
    default_enabled: bool = True


@dataclass
class Context:
    items: DataFrame
    sections: DataFrame
    uris: DataFrame | None = None
    openalex_works: DataFrame | None = None
    options: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.by_doi = I.by_doi(self.items)


class Providers:
    """Strategies by id; unknown and repeated ids are errors that name what is known."""

    def __init__(self) -> None:
        self.known: dict[str, Provider] = {}

    def register(self, p: Provider) -> Provider:
        if not p.id or not callable(p.derive):
            raise ValueError("a provider needs an id and a derive function")
        if p.id in self.known:
            raise ValueError(f"provider {p.id} is registered twice")
        self.known[p.id] = p
        return p

    def select(self, only: list[str] | None = None, without: tuple[str, ...] = (), offline: bool = False) -> list[Provider]:
        for name in [*(only or []), *without]:
            if name not in self.known:
                raise ValueError(f"no provider {name}; known: {', '.join(sorted(self.known))}")
        chosen = [self.known[n] for n in only] if only is not None else [p for p in self.known.values() if p.default_enabled]
        return [p for p in chosen if p.id not in without and not (offline and p.requires_network)]


PROVIDERS = Providers()
PROVIDERS.register(Provider("pdf-links", "Links in PDFs", lambda c: X.pdf_links(c.uris, c.items, c.by_doi, **c.options.get("pdf-links", {}))))
PROVIDERS.register(Provider("text-doi", "DOIs in reference sections", lambda c: X.text_doi(c.sections, c.items, c.by_doi, **c.options.get("text-doi", {}))))
PROVIDERS.register(Provider("title-match", "Titles in reference sections", lambda c: X.title_match(c.sections, c.items, **c.options.get("title-match", {}))))
PROVIDERS.register(Provider("locator-match", "Journal, volume and page", lambda c: X.locator_match(c.sections, c.items, **c.options.get("locator-match", {}))))
PROVIDERS.register(Provider("ref-strings", "Parsed references", lambda c: X.resolve_entries(X.entries(c.sections), c.items, **c.options.get("ref-strings", {})).select(*X.EDGE), default_enabled=False))
PROVIDERS.register(Provider("openalex", "A second source's references", lambda c: X.openalex_edges(c.openalex_works, c.items), requires_network=True, default_enabled=False))


@dataclass
class Graph:
    items: DataFrame
    candidates: DataFrame
    edges: DataFrame
    external: DataFrame
    errors: dict[str, str]


def build(context: Context, *, only: list[str] | None = None, without: tuple[str, ...] = (), offline: bool = True, partial: bool = False) -> Graph:
    """Runs the chosen strategies. One that fails fails the build; with `partial` it is reported in `errors` and the others' edges stand."""
    parts, errors = [], {}
    for p in PROVIDERS.select(only, without, offline):
        try:
            parts.append(stage(p.derive(context).select(*X.EDGE)))  # one plan for each: all at once fill the driver's memory
        except Exception as e:  # noqa: BLE001 - one strategy's failure is no other's
            if not partial:
                raise RuntimeError(f"strategy {p.id} failed") from e
            errors[p.id] = str(e)
    if not parts:
        raise ValueError(f"no strategy gave edges: {errors}")
    candidates = parts[0]
    for p in parts[1:]:
        candidates = candidates.unionByName(p)
    candidates = stage(E.validate(candidates, context.items))
    merged = stage(E.merge(candidates))
    return Graph(context.items, candidates, merged, E.external_nodes(merged), errors)
