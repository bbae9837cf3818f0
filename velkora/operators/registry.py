"""Rules by module: a decorator collects what a module declares, factories make rules of one shape."""

from __future__ import annotations

from collections.abc import Callable

from .fixpoint import Derivation, Emit, Relation, Rule
from .rules import Event, Rel, Var


class Registry:
    """Rules and derivations in the order they are declared; a name may be used once."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []
        self.derivations: list[Derivation] = []
        self._names: set[str] = set()

    def add(self, *items: Rule | Derivation) -> None:
        for x in items:
            if x.name in self._names:
                raise ValueError(f"{x.name} is declared twice")
            self._names.add(x.name)
            (self.rules if isinstance(x, Rule) else self.derivations).append(x)

    def __call__(self, make: Callable[[], Rule | Derivation | list]) -> Callable:
        """Decorator of a function that gives a rule, a derivation or a list of them."""
        made = make()
        self.add(*(made if isinstance(made, list) else [made]))
        return make


def announcement(action: str, said: str, speaker: str = "agent") -> Rule:
    """Whoever does ``action`` announces it."""
    x = Var("x")
    return Rule(f"{said} after {action}", Event(action, {speaker: x}), None, (Emit(said, {speaker: x}),))


def per_locative(relations: tuple[str, ...], above: str) -> list[Derivation]:
    """For each locative relation: what stands in something stands where that stands."""
    x, y, z = Var("x"), Var("y"), Var("z")
    return [Derivation(f"{r} through {above}", Rel(r, x, y) & Rel(above, y, z), (Relation(above, x, z),)) for r in relations]
