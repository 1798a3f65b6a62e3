"""Scalar building blocks, all JVM-side ``Column`` expressions."""
