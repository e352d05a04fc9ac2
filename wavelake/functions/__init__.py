"""Column expressions: rock physics, transforms, trace windows."""
