from haze.cli import main

main()
