"""What to do with a block: a model, up to four transforms, up to four entropy coders."""

from __future__ import annotations

from dataclasses import dataclass, field

from blockweave.errors import BlockError

MAX_STAGES = 4


@dataclass(frozen=True)
class CodecSpec:
    """Ids and parameters of the stages; the default keeps the elements as they are. Zeros end a chain, and
    nothing but zeros may follow one."""

    model: int = 1
    transforms: tuple[int, ...] = ()
    entropies: tuple[int, ...] = ()
    model_params: dict = field(default_factory=dict)
    transform_params: tuple[dict, ...] = ()
    entropy_params: tuple[dict, ...] = ()

    def __post_init__(self):
        for name in ("transforms", "entropies"):
            chain = tuple(int(x) for x in getattr(self, name))
            ids = tuple(x for x in chain if x)
            if len(chain) > MAX_STAGES:
                raise BlockError(f"{name}: {MAX_STAGES} at most")
            if ids != chain[: len(ids)]:
                raise BlockError(f"{name}: a stage after the end of the chain")
            object.__setattr__(self, name, ids)

    def params(self, kind: str, i: int) -> dict:
        given = getattr(self, f"{kind}_params")
        return dict(given[i]) if i < len(given) and given[i] else {}
