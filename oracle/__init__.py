"""The registered queries once more, as SQL for a second engine."""
