"""Extension modules and the rules that they must keep before a table uses them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from loomstone.errors import ModuleRejected
from loomstone.operators.streams import StreamProvider


@dataclass(frozen=True)
class Module:
    """What an extension brings. ``providers`` open candidate streams; the other members are names."""

    module_id: str
    version: str = "0"
    types: tuple[str, ...] = ()
    operators: tuple[str, ...] = ()
    providers: tuple[StreamProvider, ...] = ()
    segment_codecs: tuple[str, ...] = ()
    log_decoders: tuple[str, ...] = ()
    explain_hooks: tuple[str, ...] = ()
    hidden_state: bool = False


@dataclass
class Registry:
    """Registered modules in the order in which they came."""

    modules: list[Module] = field(default_factory=list)

    def register(self, module: Module) -> None:
        """Adds a module; one that is there already stays as it is.

        State that the log does not know of could not be recovered, a stream
        without an explanation could not be audited, and a file format without a
        log decoder could not be replayed: such modules are refused.
        """
        if module.hidden_state:
            raise ModuleRejected(f"module {module.module_id!r} keeps state outside the log")
        if module.providers and not module.explain_hooks:
            raise ModuleRejected(f"module {module.module_id!r} opens streams that it does not explain")
        if module.segment_codecs and not module.log_decoders:
            raise ModuleRejected(f"module {module.module_id!r} writes segments whose commits it cannot read")
        if module.module_id not in self.ids():
            self.modules.append(module)

    def ids(self) -> list[str]:
        return [m.module_id for m in self.modules]

    def providers(self) -> Sequence[StreamProvider]:
        return [p for m in self.modules for p in m.providers]
