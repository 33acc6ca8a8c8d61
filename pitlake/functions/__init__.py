"""Column expressions: all built-in, inside whole-stage codegen, no UDFs."""
