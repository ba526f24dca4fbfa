"""Choice of whole skills and tasks for a catalogue profile within a token budget.

The words of tasks and the order in which they are tried first are columns. The choice itself is made entity by
entity: every step asks what the rendered text would cost, so it can't be a set operation. ``choose`` is a pandas
function over rows that already hold their lists, so no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letter_words, once
from ..functions.tokens import Costs, TokenCounter
from ..schemas import BUDGET, TARGET

RESERVED_TASKS, RESERVED_SKILLS, SKILL_SHARE = 2, 5, 0.4


class DoesNotFit(ValueError):
    pass


def render(title: str, description: str, skills: list[str], tasks: list[str]) -> str:
    labelled = (("Occupation", title), ("Description", description), ("Skills", "; ".join(skills)), ("Tasks", " ".join(tasks)))
    return " ".join(f"{label}: {text}" for label, text in labelled if text)


@dataclass
class CatalogChoice:
    title: str
    description: str
    skills: list[str]
    tasks: list[dict]  # text, core, support, words; in source order
    counter: TokenCounter | Costs
    budget: int = BUDGET
    with_skills: list[int] = field(default_factory=list)
    with_tasks: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.costs = self.counter if isinstance(self.counter, Costs) else Costs(self.counter)
        self._words = [frozenset(t["words"]) for t in self.tasks]
        self._alone = self.costs.whole(render(self.title, self.description, [], []))
        if self.costs.adds_up:
            piece = self.costs.piece
            self._of_skill, self._of_task = [piece(s) for s in self.skills], [piece(t["text"]) for t in self.tasks]
            self._skills_label, self._tasks_label, self._between = piece("Skills:"), piece("Tasks:"), piece(";")
        self._base = self.cost((), ())
        if self._base > self.budget:
            raise DoesNotFit(f"{self.title}: its title and description alone take more than {self.budget} tokens")

    def text(self, skills, tasks) -> str:
        """Skills in rank order and tasks in source order, however they were picked."""
        return render(self.title, self.description, [self.skills[i] for i in sorted(skills)], [self.tasks[i]["text"] for i in sorted(tasks)])

    def cost(self, skills, tasks) -> int:
        if not self.costs.adds_up:
            return self.costs.whole(self.text(skills, tasks))
        total = self._alone + sum(self._of_task[i] for i in tasks) + sum(self._of_skill[i] for i in skills)
        return total + (self._tasks_label if any(self.tasks[i]["text"] for i in tasks) else 0) + (self._skills_label + self._between * (len(skills) - 1) if skills else 0)

    def plus_skill(self, now: int, skills, tasks, i: int) -> int:
        """The cost with one skill more than skills, which with tasks cost now; without looking at those again where counts add up."""
        if not self.costs.adds_up:
            return self.cost([*skills, i], tasks)
        return now + self._of_skill[i] + (self._between if skills else self._skills_label)

    def plus_task(self, now: int, skills, tasks, i: int) -> int:
        """The cost with one task more."""
        if not self.costs.adds_up:
            return self.cost(skills, [*tasks, i])
        first = self.tasks[i]["text"] and not any(self.tasks[k]["text"] for k in tasks)
        return now + self._of_task[i] + (self._tasks_label if first else 0)

    def open_tasks(self) -> list[int]:
        """Tasks not chosen: core first, then support and the share of new words, then source order."""
        said = frozenset().union(*(self._words[i] for i in self.with_tasks))
        weight = {i: self.tasks[i]["support"] / 100 + len(w - said) / max(1, len(w)) for i, w in enumerate(self._words) if i not in self.with_tasks}
        return sorted(weight, key=lambda i: (not self.tasks[i]["core"], -weight[i], i))

    def _first_beside(self, skills) -> int | None:
        now = self.cost(skills, self.with_tasks)
        return next((i for i in self.open_tasks() if self.plus_task(now, skills, self.with_tasks, i) <= self.budget), None)

    def reserve_tasks(self) -> None:
        """Two tasks that leave room for the best skills, for as many of five as can be."""
        for _ in range(RESERVED_TASKS):
            beside = (self._first_beside(range(n)) for n in reversed(range(min(RESERVED_SKILLS, len(self.skills)) + 1)))
            task = next((i for i in beside if i is not None), None)
            if task is not None:
                self.with_tasks.append(task)

    def spend_on_skills(self) -> None:
        """Skills in rank order within their share of what the description leaves; one too large is passed over."""
        share = self._base + max(0, int((self.budget - self._base) * SKILL_SHARE))
        alone, now = self.cost(self.with_skills, ()), self.cost(self.with_skills, self.with_tasks)
        for i in range(len(self.skills)):
            more_alone = self.plus_skill(alone, self.with_skills, (), i)
            if more_alone <= share and (more := self.plus_skill(now, self.with_skills, self.with_tasks, i)) <= self.budget:
                self.with_skills.append(i)
                alone, now = more_alone, more

    def fill_tasks(self) -> None:
        while (i := self._first_beside(self.with_skills)) is not None:
            self.with_tasks.append(i)

    def fill_skills(self) -> None:
        now, had = self.cost(self.with_skills, self.with_tasks), set(self.with_skills)
        for i in range(len(self.skills)):
            if i not in had and (more := self.plus_skill(now, self.with_skills, self.with_tasks, i)) <= self.budget:
                self.with_skills.append(i)
                now = more

    def exchange_tasks(self) -> None:
        """Under the target, trade one task for another not less core, each time the trade that adds most."""
        while (now := self.cost(self.with_skills, self.with_tasks)) < TARGET:
            best, trade = now, None
            for into in self.open_tasks():
                for out in reversed(self.with_tasks):
                    if self.tasks[into]["core"] >= self.tasks[out]["core"] and best < (cost := self._traded(now, out, into)) <= self.budget:
                        best, trade = cost, (out, into)
            if trade is None:
                return
            self.with_tasks = [*(i for i in self.with_tasks if i != trade[0]), trade[1]]

    def _traded(self, now: int, out: int, into: int) -> int:
        if self.costs.adds_up:
            return now - self._of_task[out] + self._of_task[into]
        return self.cost(self.with_skills, [*(i for i in self.with_tasks if i != out), into])

    def fill_rest(self) -> None:
        self.fill_skills()
        now = self.cost(self.with_skills, self.with_tasks)
        for i in self.open_tasks():
            if (more := self.plus_task(now, self.with_skills, self.with_tasks, i)) <= self.budget:
                self.with_tasks.append(i)
                now = more

    def run(self) -> tuple[str, int, list[int], list[int]]:
        """text, its tokens, chosen skills and tasks in the order they were chosen."""
        for phase in (self.reserve_tasks, self.spend_on_skills, self.fill_tasks, self.fill_skills, self.exchange_tasks, self.fill_rest):
            phase()
        if self.tasks and not self.with_tasks:
            raise DoesNotFit(f"{self.title}: none of its tasks has room")
        return self.text(self.with_skills, self.with_tasks), self.cost(self.with_skills, self.with_tasks), self.with_skills, self.with_tasks


CHOICE = "profile_text string, token_count int, selected_skills string, selected_tasks string, error string"


def _with_words(tasks: Column) -> Column:
    return F.transform(tasks, lambda t: t.withField("words", letter_words(t["text"])))


def choose(rows: DataFrame, counter: TokenCounter, key: str, budget: int = BUDGET) -> DataFrame:
    """key and CHOICE for rows with title, description, skills and tasks; what doesn't fit has an error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = Costs(counter, 16_384)  # what many entities have in common is counted once
        for batch in batches:
            out = []
            for k, title, description, skills, tasks in zip(batch[key], batch["title"], batch["description"], batch["skills"], batch["tasks"], strict=True):
                names, records = list(skills), [dict(t) for t in tasks]
                try:
                    text, n, s, t = CatalogChoice(title, description, names, records, costs, budget).run()
                    out.append((k, text, n, "; ".join(names[i] for i in sorted(s)), " ".join(records[i]["text"] for i in sorted(t)), None))
                except DoesNotFit as error:
                    out.append((k, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in CHOICE.split(", ")]]).astype({"token_count": "Int32"})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "title", "description", "skills", _with_words(F.col("tasks")).alias("tasks")).mapInPandas(run, f"`{key}` {kind}, {CHOICE}")


def priorities(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, core, support, priority: the order in which an entity's tasks are tried before any is chosen, when all words are new."""
    new = lambda t: F.when(F.size(t["words"]) > 0, 1.0).otherwise(0.0)
    keyed = F.transform(_with_words(F.col("tasks")), lambda t, i: F.struct((~t["core"]).alias("late"), (-(t["support"] / 100 + new(t))).alias("weight"), i.alias("place"), t["pos"].alias("pos"), t["core"].alias("core"), t["support"].alias("support")))
    ranked = once(F.array_sort(keyed), lambda a: F.transform(a, lambda t, i: F.struct(t["pos"], t["core"], t["support"], (i + 1).alias("priority"))))
    return rows.select(key, F.inline(ranked))
