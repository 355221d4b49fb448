"""How plans are cut, shipped and sized: helpers that every operator shares."""
