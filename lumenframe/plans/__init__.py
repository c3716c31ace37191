"""Plan building blocks: materialisation, size-checked broadcasts, graph iteration."""
