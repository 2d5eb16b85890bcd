"""Table jobs: sampling, windows, evaluation, rules, formula graphs and the registry."""
