"""Column expressions: model names, projects, text, time, coercion, money."""
