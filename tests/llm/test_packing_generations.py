"""Islands of the packing evolve as long as that helps."""

import random

from ecolattice.llm import packing


def test_evolution_ends_only_when_it_no_longer_helps(monkeypatch):
    # Hard to pack: every bin of the best packing is full and has three items.
    rnd, lengths, capacity = random.Random(2), [], 2048
    for _ in range(60):
        a = rnd.randint(500, 800)
        b = rnd.randint(500, 800)
        lengths += [a, b, capacity - a - b]
    lengths.sort(reverse=True)
    seen, made = [], packing.fitness
    monkeypatch.setattr(packing, "fitness", lambda p, *a: seen.append(made(p, *a)) or seen[-1])
    crossed, cross = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: crossed.append(max(seen)) or cross(*a))
    people = packing.evolve(lengths, capacity, 5, [], packing.POPULATION, packing.GENERATIONS)
    assert sorted(i for b in people[0] for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in people[0])
    best = made(people[0], lengths, capacity)
    # Two crossovers a generation; the last GENERATIONS of them started from the best, and more came before.
    assert best > crossed[0] and len(crossed) > 2 * packing.GENERATIONS
    assert len(people[0]) == 60 or crossed[-2 * packing.GENERATIONS :] == [best] * 2 * packing.GENERATIONS
    assert best > made(packing.best_fit(lengths, capacity), lengths, capacity)
