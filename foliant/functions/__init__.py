"""Scalar functions: Column in, Column out, all inside the JVM unless a docstring says otherwise."""
